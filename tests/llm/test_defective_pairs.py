from __future__ import annotations

import random

import pytest

from rungmill.llm import defective_pairs as dp
from rungmill.llm import languages

WORDS = {
    "en": "the picture shows a wooden boat near an old harbour and two quiet gardeners who look at the evening light".split(),
    "de": "das bild zeigt ein hölzernes boot und zwei ruhige gärtner die auf das abendlicht über dem alten hafen schauen".split(),
    "fr": "l'image montre un bateau en bois près du vieux port et deux jardiniers calmes qui regardent la lumière du soir".split(),
}


def sentence(lang, rnd):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(14)).capitalize() + "."


@pytest.mark.parametrize("text", [None, "", "  \n", "-", "...", "N/A", "[no explanation]", "TBD", "null", "—"])
def test_empty(text):
    assert dp.is_empty(text)


def test_not_empty():
    assert not dp.is_empty("None of them is near the boat.") and not dp.is_empty("图片")


def test_copy():
    p = "A pencil study of a tram driver opening a wooden compass, calm mood"
    for r in (p, p.upper() + ".", f'Answer: "{p}"', "This is an image of " + p, p.replace("wooden", "copper")):
        assert dp.is_copy(p, r)
    assert not dp.is_copy(p, "The picture follows the words 'A pencil study of a tram driver', and two carpenters stand beside a maroon piano.")
    assert not dp.is_copy("", "anything") and not dp.is_copy(p, "")


@pytest.mark.parametrize("text", ["I'm sorry, but I can't describe this image.", "I must decline to explain this.", "Unfortunately I'm unable to assist with this prompt.", "This request can't be fulfilled because it may violate the usage policy.", "Ich darf zu diesem Inhalt keine Erklärung geben.", "Lo siento, no puedo describir esta imagen.", "Je ne peux pas décrire cette image.", "Dieses Bild kann ich leider nicht beschreiben.", "As a vision model, I am not able to comment on this picture."])
def test_refusal(text):
    assert dp.is_refusal(text)


@pytest.mark.parametrize("text", ['The sign reads "Sorry, closed" above a lamp.', 'The sign reads "We cannot accept cards" above a fence.', "The scene cannot be mistaken for a real event: a baker can be seen.", "A poster says «no puedo» over the door."])
def test_no_refusal(text):
    assert not dp.is_refusal(text)


def test_language_posteriors():
    rnd = random.Random(1)
    model = languages.train([(lang, sentence(lang, rnd)) for lang in WORDS for _ in range(40)])
    held = [(lang, sentence(lang, rnd)) for lang in WORDS for _ in range(30)]
    scores, letters = model.scores([t for _, t in held])
    right = sum(model.languages[k] == lang for k, (lang, _) in zip(scores.argmax(axis=1), held, strict=True))
    assert right >= 0.97 * len(held) and (letters > 0).all()
    assert languages.train([("en", "a")]).languages == ["en"]


def test_defective_pairs(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(k, sentence(lang, rnd), lang.upper() if k % 5 else f"{lang}-XX") for k, lang in enumerate(lang for lang in WORDS for _ in range(40))] + [(900, None, "en"), (901, "x", None), (902, "zz " * 30, "und")], "doc_id long, text string, lang string")
    rows, want = [], {}
    for k in range(1200):
        lang = "de" if k % 10 == 0 else "en"
        p, r = sentence(lang, rnd).rstrip(".") + "".join(f", no {rnd.randrange(10**6)}" for _ in range(12)), " ".join(sentence(lang, rnd) for _ in range(3))
        if k % 20 == 1:
            r, want[k] = rnd.choice([None, " ", "TBD"]), "empty"
        elif k % 20 == 2:
            r, want[k] = sentence("fr", rnd), "other_language"
        elif k % 20 == 3:
            r, want[k] = r[: rnd.randrange(60, len(r) - 5)].rstrip(". "), "truncated"
        elif k % 20 == 4:
            r, want[k] = "I must decline to explain this.", "refusal"
        elif k % 20 == 5:
            r, want[k] = f"Prompt: {p}", "copy"
        rows.append((k, "safe", p, r, "x"))
    rows.append((5000, "safe", None, "x", "x"))
    df = spark.createDataFrame(rows, "id long, part string, prompt string, response string, defect string")
    got = {r["id"]: r["defect"] for r in dp.defective_pairs(df, docs).collect()}
    wrong = {k for k in {*got, *want} if got.get(k) != want.get(k)}
    assert len(wrong) <= 0.02 * len(rows), {k: (got.get(k), want.get(k)) for k in wrong}
    assert dp.defective_pairs(df.limit(0), docs.limit(0)).count() == 0


def test_rung_pairs(spark):
    rung = "struct<prompt string, image_path string, explanation string>"
    df = spark.createDataFrame([(1, "g", ("p", "i", "e"), (None, "i", "e"), None, ("", None, None))], "record_ordinal long, generator_model string, " + ", ".join(f"rung_{x} {rung}" for x in dp.LEVELS))
    assert sorted(tuple(r) for r in dp.rung_pairs(df).select("id", "part", "prompt").collect()) == [(1, "high_risk", ""), (1, "safe", "p")]


def test_copies_do_not_vouch_for_their_ending(spark):
    rows = [(k, "safe", "p", f"A crane lifts box number {k} over the wall.") for k in range(300)] + [(k, "safe", "p", "Here one sees a masked intruder cra") for k in range(300, 302)]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    got = dp.defective_pairs(spark.createDataFrame(rows, "id long, part string, prompt string, response string"), docs).collect()
    assert {(r["id"], r["defect"]) for r in got} == {(300, "truncated"), (301, "truncated")}
