"""Queries of the core, by name, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungmill.functions import identity, levels, prompts
from rungmill.operators import components as comp
from rungmill.operators import dedup, export, judge, ladders, quota, similarity, verify
from rungmill.plans.staging import Staging
from rungmill.sources import images, jsonl
from rungmill.streaming import resume

SAMPLES = 2000
COSINE = 0.30  # the test vectors have no pair of 0.95, the operator's usual threshold

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LEVELS = "('safe', 'low_risk', 'mid_risk', 'high_risk')"
_NORM = "(CASE WHEN regexp_replace(regexp_replace(lower({0}), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g') IN " + _LEVELS + " THEN regexp_replace(regexp_replace(lower({0}), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g') END)"
_BARE = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_TAXONOMY = "(SELECT unnest([" + ", ".join(f"'{x}'" for x in levels.TAXONOMY) + "]) AS name)"
_RANKS = "(VALUES ('safe', 0), ('low_risk', 1), ('mid_risk', 2), ('high_risk', 3))"
_KEYS = ["category", "target_severity", "prompt_unsafe"]
_DEDUP = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY category, target_severity, prompt_unsafe ORDER BY length(prompt_safe) DESC NULLS LAST, record_ordinal) AS place FROM metadata),
kept AS (SELECT * FROM r WHERE place = 1 OR category IS NULL OR target_severity IS NULL OR prompt_unsafe IS NULL)
"""


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "metadata").select("record_ordinal", *_KEYS, "prompt_safe")
    return dedup.exact_dedup(meta, _KEYS, F.char_length("prompt_safe"), "record_ordinal")


@query(_DEDUP + "SELECT record_ordinal, category, target_severity, prompt_unsafe, prompt_safe FROM kept")
def exact_dedup_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each category, severity and unsafe prompt: that with the longest safe prompt."""
    return _deduped(spark, sf_dir)


@query(_DEDUP + "SELECT (SELECT count(*) FROM metadata)::BIGINT AS rows_in, count(*)::BIGINT AS rows_out, ((SELECT count(*) FROM metadata) - count(*))::BIGINT AS removed FROM kept")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.removed(table(spark, sf_dir, "metadata"), _deduped(spark, sf_dir))


@query("SELECT coalesce(category, '') AS category, count(*)::BIGINT AS n FROM seeds GROUP BY 1")
def count_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "seeds").groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT sum(n)::BIGINT AS total FROM (SELECT category, count(*) AS n FROM seeds GROUP BY 1)")
def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_category(spark, sf_dir).agg(F.sum("n").alias("total"))


@query("SELECT count(DISTINCT ladder_id)::BIGINT AS n_ladders FROM metadata")
def distinct_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "metadata").agg(F.countDistinct("ladder_id").alias("n_ladders"))


@query(f"SELECT DISTINCT category FROM seeds WHERE category IS NOT NULL AND category NOT IN (SELECT name FROM {_TAXONOMY})")
def unknown_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.unknown_categories(table(spark, sf_dir, "seeds"))


@query(f"SELECT category, {_BARE.format('name')} = {_BARE.format('category')} AS known, coalesce(name, '') AS name, n::BIGINT AS n FROM (SELECT category, count(*) AS n FROM metadata WHERE category IS NOT NULL GROUP BY 1) LEFT JOIN {_TAXONOMY} ON {_BARE.format('name')} = {_BARE.format('category')}")
def category_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of categories with the taxonomy's name."""
    x = table(spark, sf_dir, "metadata").where("category is not null").groupBy("category").agg(F.count("*").alias("n"))
    name = levels.norm_category(F.col("category"))
    return x.select("category", F.when(name.isNotNull(), True).alias("known"), F.coalesce(name, F.lit("")).alias("name"), "n")


@query(f"SELECT {_NORM.format('target_severity')} AS level, rank::BIGINT AS rank, count(*)::BIGINT AS n FROM metadata LEFT JOIN {_RANKS} r(l, rank) ON l = {_NORM.format('target_severity')} GROUP BY 1, 2")
def level_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by level, read despite spelling."""
    lv = levels.norm_level(F.col("target_severity"))
    return table(spark, sf_dir, "metadata").groupBy(lv.alias("level")).agg(F.count("*").alias("n")).select("level", levels.level_rank(F.col("level")).alias("rank"), "n")


_NEEDED = f"""
WITH c AS (SELECT coalesce(category, '') AS category, count(*) AS n FROM seeds GROUP BY 1),
plan AS (SELECT name AS category, coalesce(n, 0)::BIGINT AS existing, ({SAMPLES} - coalesce(n, 0))::BIGINT AS needed FROM {_TAXONOMY} LEFT JOIN c ON c.category = name WHERE {SAMPLES} - coalesce(n, 0) > 0)
"""


@query(_NEEDED + "SELECT * FROM plan")
def quota_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many seeds each category still needs."""
    return quota.needed(table(spark, sf_dir, "seeds"), SAMPLES)


@query(_NEEDED + ", r AS (SELECT record_ordinal, category, row_number() OVER (PARTITION BY category ORDER BY record_ordinal) AS place FROM metadata) SELECT record_ordinal, category FROM r JOIN plan USING (category) WHERE place <= needed")
def quota_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records of metadata that fill these quotas."""
    return quota.take(table(spark, sf_dir, "metadata").select("record_ordinal", "category"), quota_plan(spark, sf_dir), SAMPLES, "record_ordinal")


@query(f"SELECT {len(levels.TAXONOMY)}::BIGINT AS categories, {SAMPLES}::BIGINT AS samples, {len(levels.TAXONOMY) * SAMPLES}::BIGINT AS total")
def plan_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.plan_total(spark, SAMPLES)


@query(f"SELECT name AS category, {SAMPLES}::BIGINT AS samples FROM {_TAXONOMY}")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.dry_run(spark, SAMPLES)


_SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


@query(
    "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split("
    + _strip("text")
    + ", chr(10)), lambda x: "
    + _strip(f"regexp_replace(x, '^\\p{{Nd}}+[.)]{_SPACE}*', '')")
    + "), lambda x: length(x) > 15)[1:5] AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(p) AS prompt, (generate_subscripts(p, 1) - 1)::BIGINT AS place FROM l"
)
def parse_prompt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five prompts of the list in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(prompts.prompt_list(F.col("text"), 5)).alias("place", "prompt"))
    return docs.select("doc_id", "prompt", F.col("place").cast("long").alias("place"))


@query("SELECT vec_id_a AS a, vec_id_b AS b FROM (SELECT x.vec_id AS vec_id_a, y.vec_id AS vec_id_b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE s >= 0.3")
def safe_anchor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of one label whose cosine is at least 0.3."""
    return similarity.cosine_edges(table(spark, sf_dir, "embeddings"), COSINE).select("a", "b")


_CLUSTERS = """
WITH RECURSIVE e AS (SELECT x.vec_id AS u, y.vec_id AS v FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id
      WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3),
reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.v, r.m FROM reach r JOIN e ON e.u = r.n WHERE e.v > r.m),
c AS (SELECT n AS vec_id, min(m) AS cluster FROM reach GROUP BY n),
l AS (SELECT DISTINCT label, cluster FROM c JOIN embeddings USING (vec_id)),
i AS (SELECT label, cluster, printf('%s_%04d', label::VARCHAR, row_number() OVER (PARTITION BY label ORDER BY cluster) - 1) AS ladder_id FROM l),
s AS (SELECT vec_id, label, cluster, embedding[1]::DOUBLE AS score FROM c JOIN embeddings USING (vec_id)),
a AS (SELECT cluster, vec_id AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, vec_id) AS p FROM s) WHERE p = 1)
"""


@query(_CLUSTERS + "SELECT vec_id, s.label, s.cluster, ladder_id, anchor FROM s JOIN i ON i.cluster = s.cluster AND i.label = s.label JOIN a ON a.cluster = s.cluster")
def safe_anchor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster, ladder id and anchor (the member whose first component is largest)."""
    vectors = table(spark, sf_dir, "embeddings")
    edges = similarity.cosine_edges(vectors, COSINE)
    records = vectors.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("score"))
    return ladders.assign_ladders(records, edges, "vec_id", "label", "score").select(F.col("ordinal").alias("vec_id"), F.col("category").alias("label"), "cluster", "ladder_id", "anchor")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT record_a AS u, record_b AS v FROM match_pairs WHERE record_a <> record_b UNION SELECT record_b, record_a FROM match_pairs WHERE record_a <> record_b),
low AS (SELECT u AS n, least(u, min(v)) AS m FROM e GROUP BY u),
reach(n, m) AS (SELECT n, m FROM low WHERE n = m UNION SELECT e.v, r.m FROM reach r JOIN e ON e.u = r.n WHERE e.v > r.m)
SELECT n AS node, min(m) AS component FROM reach GROUP BY n
""")
def pair_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of all pairs of the matcher, whatever their score."""
    return comp.components(table(spark, sf_dir, "match_pairs"), "record_a", "record_b")


@query(f"SELECT l.ladder_id, r.level, r.rank::BIGINT AS rank FROM (SELECT DISTINCT ladder_id FROM metadata WHERE ladder_id IS NOT NULL) l, {_RANKS} r(level, rank) WHERE NOT EXISTS (SELECT 1 FROM metadata m WHERE m.ladder_id = l.ladder_id AND {_NORM.format('m.target_severity')} = r.level)")
def ladder_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that the ladders of metadata lack."""
    return ladders.gaps(table(spark, sf_dir, "metadata"))


@query("WITH r AS (SELECT ladder_id, record_ordinal AS o, prompt_unsafe AS p, " + _NORM.format("target_severity") + " AS lv FROM metadata WHERE ladder_id IS NOT NULL) SELECT ladder_id, " + ", ".join(f"(list(p ORDER BY o) FILTER (lv = '{x}'))[1] AS {x}" for x in levels.LEVELS) + " FROM r GROUP BY ladder_id")
def ladder_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each ladder with the first unsafe prompt of each level."""
    return ladders.pivot(table(spark, sf_dir, "metadata"), "prompt_unsafe", "record_ordinal")


@query(" UNION ALL ".join(f"SELECT record_ordinal, '{x}' AS level, {k}::BIGINT AS rank, rung_{x}.prompt AS prompt, rung_{x}.image_path AS image_path, rung_{x}.explanation AS explanation, mllm_score_{x} AS score FROM metadata_subset WHERE rung_{x} IS NOT NULL" for k, x in enumerate(levels.LEVELS)))
def rungs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders as one row for each rung."""
    return ladders.rungs_long(table(spark, sf_dir, "metadata_subset"), ["record_ordinal"])


_S = {x: f"CASE WHEN isnan(mllm_score_{x}) THEN NULL ELSE mllm_score_{x} END" for x in levels.LEVELS}
_PAIRS = list(zip(levels.LEVELS, levels.LEVELS[1:], strict=False))


@query(
    "WITH s AS (SELECT record_ordinal, " + ", ".join(f"{c} AS {x}" for x, c in _S.items()) + " FROM metadata_subset), b AS (SELECT record_ordinal, ("
    + " OR ".join(f"{x} IS NULL" for x in levels.LEVELS)
    + ") AS partial, concat_ws(',', "
    + ", ".join(f"CASE WHEN round({hi} - {lo}, 6) < 0.4::DOUBLE THEN '{lo}-{hi}' END" for lo, hi in _PAIRS)
    + ") AS broken FROM s) SELECT record_ordinal, partial, broken, (NOT partial AND broken = '') AS valid FROM b"
)
def ladder_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the scores of each ladder rise by 0.4 from level to level, and which pairs do not."""
    x = verify.monotonic(table(spark, sf_dir, "metadata_subset"))
    return x.select("record_ordinal", "partial", F.concat_ws(",", F.transform("broken", lambda p: F.concat_ws("-", p["lo"], p["hi"]))).alias("broken"), "valid")


@query(f"SELECT record_ordinal, rule FROM metadata LEFT JOIN rules r ON {_BARE.format('metadata.category')} = {_BARE.format('r.category')} AND {_NORM.format('target_severity')} = r.level")
def rules_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of each record's category and level."""
    meta = table(spark, sf_dir, "metadata").select("record_ordinal", "category", "target_severity")
    return judge.with_rules(meta, table(spark, sf_dir, "rules")).select("record_ordinal", "rule")


@query("SELECT record_ordinal, ladder_id FROM (SELECT record_ordinal, ladder_id, " + ", ".join(f"{c} AS {x}" for x, c in _S.items()) + " FROM metadata_subset) WHERE " + " AND ".join(f"round({hi} - {lo}, 6) >= 0.4::DOUBLE" for lo, hi in _PAIRS))
def ladders_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladders whose scores are complete and rise from level to level."""
    return verify.keep_valid(table(spark, sf_dir, "metadata_subset")).select("record_ordinal", "ladder_id")


@query("SELECT record_ordinal, concat_ws(',', " + ", ".join(f"CASE WHEN floor({c} + 0.5) <> {k} THEN '{x}' END" for k, (x, c) in enumerate(_S.items())) + ") AS mismatched FROM metadata_subset")
def ladder_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of each ladder whose score rounds to another level."""
    return verify.mismatched_levels(table(spark, sf_dir, "metadata_subset")).select("record_ordinal", F.array_join("mismatched", ",").alias("mismatched"))


@query("SELECT record_ordinal, ladder_id FROM metadata_subset WHERE ladder_id IS NULL OR ladder_id NOT IN (SELECT ladder_id FROM metadata_subset WHERE rung_safe.verdict = 'ambiguous' AND ladder_id IS NOT NULL)")
def poisoned_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders without those whose safe rung was found ambiguous in any delivery."""
    subset = table(spark, sf_dir, "metadata_subset")
    flagged = subset.where("rung_safe.verdict = 'ambiguous'").select("ladder_id")
    return judge.drop_poisoned(subset.select("record_ordinal", "ladder_id"), flagged)


@query("SELECT record_ordinal FROM metadata m WHERE NOT EXISTS (SELECT 1 FROM metadata_subset s WHERE s.ladder_id IS NOT DISTINCT FROM m.ladder_id AND s.generator_model IS NOT DISTINCT FROM m.generator_model)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of metadata whose ladder and generator have no ladder record yet."""
    meta = table(spark, sf_dir, "metadata").select("record_ordinal", "ladder_id", "generator_model")
    return judge.remaining(meta, table(spark, sf_dir, "metadata_subset"), ["ladder_id", "generator_model"]).select("record_ordinal")


_PUBLIC = "SELECT ladder_id, category, generator_model, red_team_model, seed, " + ", ".join(f"rung_{x}.{k} AS {x}_{k}" for x in levels.LEVELS for k in export.KEPT_RUNG) + " FROM metadata_subset"


@query(_PUBLIC)
def export_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public projection, with rungs laid flat."""
    flat = [F.col(f"rung_{x}.{k}").alias(f"{x}_{k}") for x in levels.LEVELS for k in export.KEPT_RUNG]
    return export.public(table(spark, sf_dir, "metadata_subset")).select(*export.KEPT, *flat)


@query(_PUBLIC)
def export_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of JSON lines and records of any shape: written, read strictly, projected, laid flat."""
    path = Staging(spark, "export").base + "/ladders"
    jsonl.write(table(spark, sf_dir, "metadata_subset"), path)
    x = export.public_open(jsonl.read_strict(spark, path))
    top = lambda k: F.try_element_at("record", F.lit(k))
    kept = [F.try_variant_get(top(k), "$", "bigint" if k == "seed" else "string").alias(k) for k in export.KEPT]
    return x.select(*kept, *[F.try_variant_get(top(f"rung_{r}"), f"$.{k}", "string").alias(f"{r}_{k}") for r in levels.LEVELS for k in export.KEPT_RUNG])


_SEEDS = "SELECT record_ordinal, category, prompt_safe, red_team_model, seed FROM seeds"


def _seed_fields(x: DataFrame) -> DataFrame:
    kinds = {"record_ordinal": "bigint", "category": "string", "prompt_safe": "string", "red_team_model": "string", "seed": "bigint"}
    return x.select(*[F.try_variant_get("record", f"$.{k}", t).alias(k) for k, t in kinds.items()])


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "seeds").select("record_ordinal", "category", "prompt_safe", "red_team_model", "seed")


@query(_SEEDS)
def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seeds, written as JSON lines and read strictly."""
    path = Staging(spark, "jsonl").base + "/deep/seeds"
    jsonl.write(_seeds(spark, sf_dir), path)
    return _seed_fields(jsonl.read_strict(spark, path))


@query(_SEEDS)
def jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seeds from a folder that has broken and blank lines as well, and from one that isn't there."""
    path = Staging(spark, "jsonl").base + "/seeds"
    jsonl.write(_seeds(spark, sf_dir), path)
    spark.createDataFrame([('{"broken": ',), ("[1, 2]",), ("7",), ("",), ("  \t",)], "value string").write.mode("append").text(path)
    return _seed_fields(jsonl.read_tolerant(spark, path).unionByName(jsonl.read_tolerant(spark, path + "-none")))


@query(_SEEDS + " UNION ALL " + _SEEDS)
def jsonl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seeds, written and appended once more, read under a declared schema."""
    path = Staging(spark, "jsonl").base + "/seeds"
    x = _seeds(spark, sf_dir)
    for append in (False, True):
        jsonl.write(x, path, append)
    return jsonl.read_typed(spark, path, x.schema)


@query(
    "WITH r AS ("
    + " UNION ALL ".join(f"SELECT rung_{x}.image_path AS p FROM metadata_subset" for x in levels.LEVELS)
    + "), l AS (SELECT DISTINCT 'images/' || category || '/' || target_severity || '/' || ladder_id || '_' || generator_model || '.png' AS p FROM metadata) SELECT (count(*) FILTER (l.p IS NOT NULL))::BIGINT AS found, (count(*) FILTER (l.p IS NULL))::BIGINT AS missing FROM r LEFT JOIN l ON l.p = r.p WHERE coalesce(r.p, '') <> ''"
)
def path_resolve_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references of all rungs, held against the paths that the records of metadata would have."""
    long = ladders.rungs_long(table(spark, sf_dir, "metadata_subset"), ["record_ordinal"])
    meta = table(spark, sf_dir, "metadata")
    paths = meta.select(identity.image_path(F.col("category"), F.col("target_severity"), F.col("ladder_id"), F.col("generator_model")).alias("path")).where("path is not null")
    return images.found_and_missing(long, [paths])


@query(" UNION ALL ".join(f"SELECT '{x}' AS level, (count(*) FILTER (rung_{x} IS NOT NULL AND coalesce(rung_{x}.image_path, '') = ''))::BIGINT AS unaudited, (count(*) FILTER (rung_{x} IS NOT NULL))::BIGINT AS rungs FROM metadata_subset" for x in levels.LEVELS))
def unaudited_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs without an image, by level."""
    long = ladders.rungs_long(table(spark, sf_dir, "metadata_subset"), ["record_ordinal"])
    return long.groupBy("level").agg(F.count_if(F.coalesce("image_path", F.lit("")) == "").alias("unaudited"), F.count("*").alias("rungs"))


@query(" UNION ALL ".join(f"SELECT record_ordinal, '{x}' AS level, md5(ladder_id || '|' || '{x}') AS pair, ('0x' || substr(md5(ladder_id || '|' || '{x}'), 1, 8))::BIGINT AS seed FROM metadata_subset WHERE rung_{x} IS NOT NULL" for x in levels.LEVELS))
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image seed of each rung."""
    long = ladders.rungs_long(table(spark, sf_dir, "metadata_subset"), ["record_ordinal", "ladder_id"])
    return long.select("record_ordinal", "level", identity.pair_hash(F.col("ladder_id"), F.col("level")).alias("pair"), identity.image_seed(F.col("ladder_id"), F.col("level")).alias("seed"))


@query("SELECT record_ordinal, printf('%s_%04d', category, record_ordinal) AS id FROM metadata WHERE category IS NOT NULL")
def id_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with an index of at least four digits."""
    return table(spark, sf_dir, "metadata").where("category is not null").select("record_ordinal", identity.ladder_id(F.col("category"), F.col("record_ordinal")).alias("id"))


_CONTEXTS = "[" + ", ".join(f"'{x}'" for x in levels.SCENE_CONTEXTS) + "]"


@query(f"SELECT record_ordinal, {_CONTEXTS}[(('0x' || substr(md5(concat_ws('|', category, record_ordinal, seed)), 1, 8))::BIGINT % 10 + 1)::INTEGER] AS context FROM seeds")
def scene_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene context for each seed, by hash."""
    return table(spark, sf_dir, "seeds").select("record_ordinal", identity.scene_context(F.col("category"), F.col("record_ordinal"), F.col("seed")).alias("context"))


@query("SELECT red_team_model AS alias, CASE red_team_model " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in levels.MODELS.items()) + " ELSE red_team_model END AS model, count(*)::BIGINT AS n FROM seeds GROUP BY 1, 2")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the seeds under their full ids; unknown names stand for themselves."""
    return table(spark, sf_dir, "seeds").groupBy(F.col("red_team_model").alias("alias"), levels.resolve_model(F.col("red_team_model")).alias("model")).agg(F.count("*").alias("n"))


_CASE = lambda column, models: f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in models.items()) + f" ELSE {column} END"


@query(f"SELECT record_ordinal, ladder_id, {_CASE('generator_model', levels.GENERATORS)} AS generator FROM metadata_subset")
def generator_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ladder with the full id of its generator."""
    return table(spark, sf_dir, "metadata_subset").select("record_ordinal", "ladder_id", levels.resolve_model(F.col("generator_model"), levels.GENERATORS).alias("generator"))


@query(f"SELECT category, prompt_safe, {_CASE('red_team_model', levels.MODELS)} AS red_team_model, 7::BIGINT AS seed FROM seeds")
def seed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of seeds as the records of a run with seed 7."""
    return quota.seed_records(table(spark, sf_dir, "seeds"), F.col("red_team_model"), 7, prompt="prompt_safe")


@query("SELECT record_ordinal, coalesce(r.rule, 'no rule for ' || coalesce(s.category, '')) AS instruction FROM seeds s LEFT JOIN (SELECT category, min(rule) AS rule FROM rules WHERE level = 'safe' GROUP BY 1) r USING (category)")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of each seed's category for safe texts, under the category's exact name; else a default that names the category."""
    safe = table(spark, sf_dir, "rules").where("level = 'safe'")
    return judge.lookup(table(spark, sf_dir, "seeds"), "category", safe, "category", "rule", "no rule for %s", "instruction").select("record_ordinal", "instruction")


@query("SELECT doc_id, coalesce(nullif(n_chars, 0), 100)::BIGINT AS n FROM documents")
def falsy_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated lengths of documents; null and zero give the default."""
    return table(spark, sf_dir, "documents").select("doc_id", identity.or_default(F.col("n_chars"), F.lit(100).cast("long")).alias("n"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n_events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, each event once; the same function runs on streams."""
    x = resume.windowed_counts(table(spark, sf_dir, "events"))
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("total", 2).alias("total"))


@query("SELECT 'seeds' AS source, prompt_safe AS prompt, count(*)::BIGINT AS n FROM seeds WHERE prompt_safe IS NOT NULL GROUP BY prompt_safe UNION ALL SELECT 'metadata', prompt_safe, count(*)::BIGINT FROM metadata WHERE prompt_safe IS NOT NULL GROUP BY prompt_safe")
def append_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of both tables, appended, with how often each occurs in its own."""
    seeds = table(spark, sf_dir, "seeds").select(F.lit("seeds").alias("source"), F.col("prompt_safe").alias("prompt"))
    meta = table(spark, sf_dir, "metadata").select(F.lit("metadata").alias("source"), F.col("prompt_safe").alias("prompt"))
    return seeds.unionByName(meta).where("prompt is not null").groupBy("source", "prompt").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT cluster_safe_anchor AS anchor FROM metadata_subset s WHERE EXISTS (SELECT 1 FROM metadata m WHERE m.prompt_safe = s.cluster_safe_anchor)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of ladders that are among the safe prompts of metadata."""
    anchors = table(spark, sf_dir, "metadata_subset").select(F.col("cluster_safe_anchor").alias("anchor")).where("anchor is not null").distinct()
    return anchors.join(table(spark, sf_dir, "metadata").select(F.col("prompt_safe").alias("anchor")), "anchor", "left_semi")


@query(_DEDUP + "SELECT 'dedup' AS stage, (SELECT count(*) FROM metadata)::BIGINT AS rows_in, count(*)::BIGINT AS rows_out, ((SELECT count(*) FROM metadata) - count(*))::BIGINT AS removed, count(DISTINCT ladder_id)::BIGINT AS ladders FROM kept")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of a run's figures, written as a JSON line beside the stage's output and read back."""
    meta = table(spark, sf_dir, "metadata").select("record_ordinal", *_KEYS, "prompt_safe", "ladder_id")
    stage = Staging(spark, "run")
    kept = stage.table(dedup.exact_dedup(meta, _KEYS, F.char_length("prompt_safe"), "record_ordinal"), "stage1")
    x = dedup.removed(meta, kept).crossJoin(F.broadcast(kept.agg(F.countDistinct("ladder_id").alias("ladders"))))  # one row each
    x = x.select(F.lit("dedup").alias("stage"), "rows_in", "rows_out", "removed", "ladders")
    jsonl.write(x.coalesce(1), stage.base + "/summary")
    return jsonl.read_typed(spark, stage.base + "/summary", x.schema)


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"('column', '{x}')" for x in ("audited_at", "broken_rung_pairs", "clip_align_high_risk", "clip_align_low_risk", "clip_align_mid_risk", "clip_align_safe", "cluster_safe_anchor", "ingested_at", "mllm_reasoning", "mllm_rule_alignment", "mllm_rule_level", "mllm_score_high_risk", "mllm_score_low_risk", "mllm_score_mid_risk", "mllm_score_safe", "partial_audit", "record_ordinal", "rule_mismatch_levels", "visual_ladder_valid"))
    + ", ('rung field', 'source_id'), ('rung field', 'synthetic'), ('rung field', 'verdict')) t(kind, name)"
)
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and rung fields that the export leaves out; read from the schema, without a scan."""
    subset = table(spark, sf_dir, "metadata_subset")
    rows = [("column", x) for x in export.removed_columns(subset)] + [("rung field", x) for x in export.removed_rung_fields(subset)]
    return spark.createDataFrame(rows, "kind string, name string")


@query("SELECT record_ordinal, least(length(coalesce(prompt_unsafe, '')), 300) / 100.0::DOUBLE AS score FROM metadata")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all unsafe prompts by the stub scorer, through the batch interface."""
    score = judge.scorer(judge.length_stub)
    return table(spark, sf_dir, "metadata").select("record_ordinal", score(F.col("prompt_unsafe")).alias("score"))


@query(f"SELECT record_ordinal, CASE least(length(coalesce(prompt_unsafe, '')) // 100, 3) WHEN 0 THEN 'safe' WHEN 1 THEN 'low_risk' WHEN 2 THEN 'mid_risk' ELSE 'high_risk' END AS level, CASE WHEN rule IS NULL THEN 'ambiguous' ELSE 'ok' END AS verdict FROM metadata LEFT JOIN rules r ON {_BARE.format('metadata.category')} = {_BARE.format('r.category')} AND {_NORM.format('target_severity')} = r.level")
def judge_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and verdict of all unsafe prompts under their rules, by the stub judge, through the batch interface."""
    meta = judge.with_rules(table(spark, sf_dir, "metadata"), table(spark, sf_dir, "rules"))
    verdict = judge.severity_judge(judge.word_stub)(F.col("prompt_unsafe"), F.col("rule"))
    return meta.select("record_ordinal", verdict.alias("v")).select("record_ordinal", "v.level", "v.verdict")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through two incremental runs; the second finds nothing new."""
    stage = Staging(spark, "stream")
    source = stage.base + "/source"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    events.write.mode("overwrite").json(source)
    for _ in range(2):
        resume.run_available(spark, source, "event_id long, user_id long, event_type string, value double", stage.base + "/target", stage.base + "/checkpoint", lambda x: x)
    return spark.read.schema(events.schema).parquet(stage.base + "/target").groupBy("event_type").agg(F.count("*").alias("n"))
