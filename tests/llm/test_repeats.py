import random

import pytest
from pyspark.sql import functions as F

from wardline.llm import queries, repeats
from wardline.llm.common import written


def tokens(text):
    """(word in lower case, start, end) of a text, by a walk over its characters."""
    out, at = [], None
    for k, c in enumerate(text + " "):
        if c.isspace():
            if at is not None:
                out.append((text[at:k].lower(), at, k))
                at = None
        elif at is None:
            at = k
    return out


def ranked(rows):
    import xxhash

    def version(text):
        v = xxhash.xxh64_intdigest(text.encode())
        return v - (1 << 64) if v >> 63 else v

    return sorted({(i, version(t), t) for i, t in rows if i is not None and t is not None})


def plain(rows, least=repeats.MIN_WORDS):
    """Brute force over every run of ``least`` words in rank order: {(id, start, end, words)}."""
    first, out = {}, []
    for doc, (i, _, text) in enumerate(ranked(rows)):
        found = tokens(text)
        gone = [False] * len(found)
        for k in range(len(found) - least + 1):
            run = tuple(w for w, _, _ in found[k : k + least])
            at = first.setdefault(run, (doc, k))
            if at[0] != doc or k >= at[1] + least:
                gone[k : k + least] = [True] * least
        k = 0
        while k < len(found):
            n = 0
            while k + n < len(found) and gone[k + n]:
                n += 1
            if n:
                out.append((i, found[k][1], found[k + n - 1][2], n))
            k += n + 1
    return sorted(out)


def spans(df, **options):
    return sorted(tuple(r) for r in repeats.repeated_spans(df, **options).select("doc_id", "start", "end", "n_words").collect())


def frame(spark, rows, name):
    return written(spark.createDataFrame(rows, "doc_id bigint, text string"), name)


def test_lines_and_paragraphs():
    text = " One two.\n\n  \nThree four\n five \n\n\n"
    assert [text[a:b] for a, b, _ in repeats.lines_of(text)] == ["One two.", "Three four", "five"]
    assert [(text[a:b], n) for a, b, n in repeats.lines_of(text, "paragraph")] == [("One two.", 2), ("Three four\n five", 3)]
    assert repeats.lines_of("") == repeats.lines_of(" \n\t\n") == []


@pytest.mark.parametrize("least", [1, 2, 7, 50])
def test_against_brute_force(docs, rows, least):
    assert spans(docs, min_words=least) == plain(rows, least) and (least > 20 or plain(rows, least))


def test_random_texts_against_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(40)]
    rows = []
    for k in range(150):
        parts = [r.choice(pool) if r.random() < 0.6 else " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 25))) for _ in range(r.randint(0, 8))]
        rows.append((r.randint(0, 120), r.choice([" ", "\n", "\n\n", "  \n "]).join(parts)))
    rows += [(200, "and " * 300), (201, "And " * 40 + "\n" + "and " * 90), (202, "x\n" * 120), (203, "a b c\nd e f\n" * 20)]
    df = frame(spark, rows, "random")
    for least in (2, 5, 12, 20):
        assert spans(df, min_words=least) == plain(rows, least)


def test_the_query_against_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        out = queries.op5_substring_dedup(spark, sf).collect()
        assert sorted(tuple(r)[:4] for r in out) == plain(rows)
        assert all(r["first_doc_id"] <= r["doc_id"] for r in out)


def test_repeated_lines_of_any_length(spark, docs, rows):
    for unit in ("line", "paragraph"):
        seen, want = {}, []
        for i, _, text in ranked(rows):
            cut = repeats.lines_of(text, unit)
            for place, (a, b, n) in enumerate(cut):
                key = tuple(w for w, _, _ in tokens(text[a:b]))
                if key in seen:
                    want.append((i, place, a, b, n, *seen[key]))
                else:
                    seen[key] = (i, place)
        got = repeats.repeated_lines(docs, unit=unit).select("doc_id", "place", "start", "end", "n_words", "first_doc_id", "first_place").collect()
        assert sorted(map(tuple, got)) == sorted(want) and want
    short = frame(spark, [(1, "four words are here\nown"), (2, "x\nFour  words are here")], "short")
    cut = repeats.without_repeats(short, spans=repeats.repeated_lines(short))
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "four words are here\nown", 2: "x\n"}


def test_sentences_that_stand_singly_are_no_passage(spark):
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    lines = [say(12) for _ in range(5)]
    rows = [(k, say(20) + "\n" + line + "\n" + say(20)) for k, line in enumerate(lines)] + [(9, "\n".join(lines))]
    assert spans(frame(spark, rows, "singly")) == []


def test_planted_passages_go_and_clean_documents_stay(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(6, 12))).capitalize() + "."
    say = lambda n: " ".join(sentence() for _ in range(n))
    passage = say(8)
    texts = [say(9) for _ in range(30)]
    for k in (3, 9):
        texts[k] = texts[k] + "\n" + passage.upper() + "\n" + say(3)
    texts[20] = say(3) + " " + passage + " " + say(2)
    rows = list(enumerate(texts))
    df = frame(spark, rows, "planted")
    assert {s[0] for s in spans(df)} == {9, 20}
    out = {x["doc_id"]: x for x in repeats.without_repeats(df.withColumn("removed_by", F.lit("x"))).collect()}
    for i, text in rows:
        (cut,) = out[i]["removed"] or [None]
        assert (out[i]["text"] == text) if cut is None else (out[i]["text"] == text[: cut[0]] + text[cut[1] :] and text[cut[0] : cut[1]].lower() == passage.lower())


def test_hard_rows(docs, rows):
    out = repeats.without_repeats(docs)
    assert out.count() == len(rows) and set(out.columns) == {*docs.columns, "removed"}
    assert {r["doc_id"] for r in out.where("text is null").collect()} == {1}
    assert spans(docs.limit(0)) == [] and repeats.repeated_lines(docs.limit(0)).collect() == []


def test_only_planned_texts_are_dealt_to_their_plans(spark, monkeypatch):
    docs = spark.range(-3000, 5000).selectExpr("id as doc_id", "cast('x' as binary) as text")
    plans = spark.range(-2999, 5000, 7).selectExpr("id as doc_id")
    kept = {r["doc_id"] for r in repeats._planned(docs, plans).collect()}
    asked = set(range(-2999, 5000, 7))
    assert asked <= kept and len(kept - asked) < 20
    monkeypatch.setattr(repeats, "PLAN_BITS", 1 << 8)
    assert asked <= {r["doc_id"] for r in repeats._planned(docs, plans).collect()}


def test_the_query_against_brute_force_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_PLANS", 0)
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:4] for r in queries.op5_substring_dedup(spark, sf).collect()) == plain(rows)


def test_units_and_marks_do_not_stay_on_disk(spark, docs):
    import os

    from wardline.llm.common import shared_root

    folder = shared_root(spark).removeprefix("file://") + "/wardline"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = repeats.repeated_spans(docs, min_words=7)
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith(("units-", "marks-", "common-marks-"))]
    assert found.count()
