import random
import zlib

from pyspark.sql import functions as F

from quire.llm import langid, queries


def brute_phrases(text, reference):
    """Longest matches found with `in`, one phrase after the other."""
    count, phrase = 0, ""
    for c in text:
        if phrase + c in reference:
            phrase += c
        else:
            count, phrase = count + 1, c if c in reference else ""
    return count


def test_phrases_against_brute_force():
    r = random.Random(1)
    refs = {"x": "".join(r.choice("abc") for _ in range(200)), "y": "".join(r.choice("bcd") for _ in range(300))}
    m = langid.Model(refs)
    texts = ["".join(r.choice("abcd") for _ in range(n)) for n in (0, 1, 5, 700, 1300, 64, 512)]
    assert m.phrases(texts).tolist() == [[brute_phrases(t, refs[k]) for k in m.langs] for t in texts]


def test_held_out_accuracy(spark):
    got = queries.op7_langid(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id")
    assert held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_odd(odd, empty):
    refs = langid.sample(odd, "doc_id", "text", "lang")
    assert set(refs) == {"en", "de"}
    got = langid.identify(odd, refs)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count()
    assert [by[k].lang_pred for k in (100, 101, 102, 106)] == ["und"] * 4 and by[100].score == 0
    assert all(r.lang_pred in ("en", "de") for k, r in by.items() if k is not None and k < 60)
    assert langid.sample(empty, "doc_id", "text", "lang") == {} and langid.identify(empty, {}).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_sample_is_bounded_in_rows_and_whole(spark):
    """Rows that share an id or repeat, a language of long rows only, and more rows than are wanted: whole texts, each once, the same ones again."""
    rows = [(k % 3, f"english text number {k} " * 3, "en") for k in range(400)] + [(9, "one and the same", "de")] * 500 + [(None, f"deutsch {k}", "de") for k in range(5)]
    rows += [(k, "longue histoire " * (100 + k), "fr") for k in range(8)] + [(1, None, "en"), (2, "no language", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    got = langid.sample(df, "doc_id", "text", "lang", docs=10, chars=1000)
    assert got["fr"] == "longue histoire " * 100
    assert sorted(got["de"].replace("one and the same", "@").replace("deutsch", "").split()) == ["0", "1", "2", "3", "4", "@"]
    assert got["en"].count("english text number") == 30  # ten rows of three sentences
    assert langid.sample(df.repartition(3), "doc_id", "text", "lang", docs=10, chars=1000) == got


def test_letters_of_no_known_alphabet():
    langs, scores = langid.Model({"en": "the of and", "de": "der die das"}).predict(["中文", "été", "123", None])
    assert langs[0] in ("en", "de") and langs[1] in ("en", "de") and langs[2:] == ["und", "und"]


def test_languages_of_large_alphabets():
    """Two languages of Han letters, one beyond the basic plane, and five scripts: phrases as by brute force, and each text in its own language."""
    r = random.Random(2)
    words = lambda first, n: ["".join(chr(first + r.randrange(n)) for _ in range(2)) for _ in range(150)]
    own = {"zh": words(0x4E00, 600), "ja": words(0x4E00, 600), "ext": words(0x20000, 300), "el": words(0x3B1, 17), "ru": words(0x430, 32), "ar": words(0x628, 19), "ko": words(0xAC00, 400), "en": words(0x61, 26)}
    text = lambda k, n: " ".join(r.choice(own[k]) for _ in range(n))
    refs = {k: text(k, 400) for k in own}
    m = langid.Model(refs)
    texts = {k: text(k, 250) for k in own}
    assert m.predict(list(texts.values()))[0] == list(texts)
    mixed = [*texts.values(), "".join(map("".join, zip(texts["zh"], texts["ru"], texts["en"]))), "\u3042 zz \u4e00"]
    cover = {k: "".join(c if c.isalpha() else " " for c in v) for k, v in refs.items()}
    assert m.phrases(mixed).tolist() == [[brute_phrases(t, cover[k]) for k in m.langs] for t in mixed]
