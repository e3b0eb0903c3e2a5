import re

import pytest
from pyspark.sql import functions as F

from wardline.functions import pii
from wardline.functions.fixed_values import ENTITIES
from wardline.operators import tokens

TEXTS = [
    "My SSN is 123-45-6789, please advise.",
    "Email me at alice@example.com for details.",
    "Card number: 4111 1111 1111 1111",
    "What is the weather like today?",
    "call (555) 123-4567 or +1 555 123 4567",
    "IBAN GB82WEST12345698765432, born 12/31/1990, host 10.0.0.1",
    "\U0001f600 a@b.org \U0001f600 123-45-6789 \U0001f600",
    "",
]
OVERLAPS = {
    "123-45-6789@example.com": "[REDACTED_EMAIL]com",
    "mail 10.0.0.1@a.com": "mail [REDACTED_IP_ADDRESS]D_EMAIL]",
    "user@10.0.0.1.example.com now": "[REDACTED_EMAIL]].example.com now",
}


def plain_hits(text, entities=None):
    found = [(m.start(), m.end(), e) for e in entities or ENTITIES for m in re.finditer(ENTITIES[e], text, re.I)]
    return sorted(found, key=lambda h: -h[0])


def plain_compat(text, mode):
    out = text
    for start, end, entity in plain_hits(text):
        out = out[:start] + (f"[REDACTED_{entity}]" if mode == "redact" else "*" * (end - start)) + out[end:]
    return out


def plain_separate(text):
    order = list(ENTITIES)
    kept, at = [], 0
    for start, end, entity in sorted(plain_hits(text), key=lambda h: (h[0], -h[1], order.index(h[2]))):
        if start >= at:
            kept.append((start, end, entity))
            at = end
    for start, end, entity in reversed(kept):
        text = text[:start] + f"[REDACTED_{entity}]" + text[end:]
    return text


def apply(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", column(F.col("t"))).collect(), key=lambda r: r[0])]


def test_hits_have_code_point_offsets(spark):
    texts = [*TEXTS, *OVERLAPS]
    got = apply(spark, texts, pii.hits)
    assert [[(h["start"], h["end"], h["entity"]) for h in hits] for hits in got] == [plain_hits(t) for t in texts]


@pytest.mark.parametrize("mode", ["redact", "mask"])
def test_compat_applies_every_hit_with_the_first_offsets(spark, mode):
    texts = [*TEXTS, *OVERLAPS]
    got = apply(spark, texts, lambda t: pii.transform(t, mode, overlap="compat"))
    assert got == [new if (new := plain_compat(t, mode)) != t else None for t in texts]
    if mode == "redact":
        assert got[len(TEXTS) :] == list(OVERLAPS.values())


def test_separate_keeps_the_leftmost(spark):
    texts = [*TEXTS, *OVERLAPS, None]
    got = apply(spark, texts, pii.transform)
    assert got == [None if t is None or (new := plain_separate(t)) == t else new for t in texts]


def test_subset_and_unknown_entities(spark):
    text = "SSN 123-45-6789 and email test@test.com"
    assert apply(spark, [text], lambda t: pii.transform(t, entities=["EMAIL", "NO_SUCH"])) == ["SSN 123-45-6789 and email [REDACTED_EMAIL]"]


def test_tokens_go_and_come_back(spark):
    rows = [("s1", 1, "Email: carol@example.com and carol@example.com"), ("s2", 1, "123-45-6789 or bob@example.com"), ("s2", 2, "nothing"), ("s3", 1, None)]
    df = spark.createDataFrame(rows, "session_id string, seq int, text string")
    made = tokens.token_map(df)
    hidden = df.withColumn("was", F.col("text")).withColumn("text", F.coalesce(pii.transform(F.col("text"), "tokenize", session=F.col("session_id")), F.col("text")))
    back = tokens.restore(hidden, made, row=["session_id", "seq"]).collect()
    assert len(back) == 4 and all(r["restored"] == r["was"] for r in back)
    assert all("@" not in (r["text"] or "") for r in back)
    assert made.count() == 4
    known = F.array(F.struct(F.lit("[T]").alias("token"), F.lit("x").alias("original")))
    assert tuple(spark.range(1).select(pii.resolve(known, F.lit("[T]")), pii.resolve(known, F.lit("[U]"))).first()) == ("x", None)


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        pii.transform(F.lit("x"), "erase")
    with pytest.raises(ValueError):
        pii.transform(F.lit("x"), overlap="other")
