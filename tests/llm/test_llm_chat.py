"""Chat examples: round trips, masks, and digests against plain Python."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, example string, formatted string, turns string, piece string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], SCHEMA)


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "user", "<s>[INST] </s>"), (1, 4, "assistant", "a<\\/s>b<\\\\role:x>[\\INST]"),
    (2, 0, "user", "no answer"), (3, 0, "assistant", "first\n\n"), (3, 1, None, "<"), (3, 2, "assistant", "/s>"), (4, 0, "tool <x>|%", "é😀</s"), (4, 1, "assistant", "<|im_start|>"),
    (5, None, "user", "no number"), (5, 0, "assistant", "twice"), (5, 0, "assistant", "twice"), (None, 0, "user", "no id"), (None, 1, "assistant", "none"),
    (6, 0, "user", "long " * 40_000), (6, 1, "assistant", "</s>" * 20_000),
]


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        texts = [t[2] for t in turns if t[1] == "assistant"]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len("".join(texts)), sha("".join(texts)), len(texts) + (turns[-1][1] != "assistant"))
    return out


def test_digests_read_back_from_the_examples(spark):
    got = chat_format.digests(chat_format.expand(made(spark, ODD))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["examples"]) for r in got} == plain(ODD)


def test_every_example_holds_all_turns_before_and_masks_its_reply_alone(spark):
    rows = chat_format.expand(made(spark, ODD)).withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("reply", chat_format.masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).collect()
    assert sum(len(r["formatted"]) for r in rows if r["conv_id"] == 1) == chat_format.digests(chat_format.expand(made(spark, ODD))).where("conv_id = 1").first()["formatted_chars"]
    for r in rows:
        turns = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in ODD if x[0] == r["conv_id"]))
        back = [tuple(t) for t in r["back"]]
        assert back == [t[1:] for t in turns][: len(back)]
        assert r["reply"] == (back[-1][1] if back[-1][0] == "assistant" else "")
        assert r["formatted"].startswith("<s>") and r["formatted"].count("</s>") == len(back) and r["formatted"].count("<s>") == 1


def test_no_python_and_one_shuffle(spark):
    plan = chat_format.digests(chat_format.expand(made(spark, ODD[:4])))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1 and "Python" not in plan.split("== Physical Plan ==")[1]


def test_nothing_gives_nothing(spark):
    assert chat_format.digests(chat_format.expand(made(spark, ODD).limit(0))).collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet="<[\\/s>INT]role:|im_startd", max_size=30), min_size=30, max_size=60))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(first + c in r["e"] for first in "<[" for c in chat_format.CONTROL)
