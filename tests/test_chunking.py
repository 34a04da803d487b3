import pytest

from attestor.operators.chunking import Chunking, chunk


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", "s", "p.md", t) for i, t in enumerate(texts)], "document_id string, source_id string, path string, text string")


def chunks(spark, text, *config):
    return chunk(docs(spark, text), Chunking(*config)).orderBy("ordinal").collect()


def test_windows_step_to_the_end(spark):
    got = chunks(spark, "0 1 2 3 4 5 6 7 8 9", 5, 2, "whitespace")
    assert [(r["token_count"], r["split_reason"]) for r in got] == [(5, "token_limit"), (5, "token_limit"), (4, "document_end"), (1, "document_end")]
    assert [r["text"][0] for r in got] == ["0", "3", "6", "9"]


def test_windows_keep_inner_space_and_count_bytes(spark):
    got = chunks(spark, "  é b  c\n", 2, 0, "whitespace")
    assert [(r["text"], r["byte_start"], r["byte_end"]) for r in got] == [("é b", 2, 6), ("c", 8, 9)]


def test_all_white_space_of_unicode_divides_tokens(spark):
    text = "a\u00a0b\u2028c\u3000d\x1ce\u200bf"
    got = chunks(spark, text, 1, 0, "whitespace")
    assert [r["text"] for r in got] == ["a", "b", "c", "d\x1ce\u200bf"] and [r["byte_start"] for r in got] == [0, 3, 7, 11]
    assert [r["text"] for r in chunks(spark, text, 1, 0, "structured")] == [r["text"] for r in got]


def test_windows_of_long_texts_take_time_in_proportion(spark):
    import time

    text = " ".join(f"w{i}" for i in range(400_000))
    began = time.time()
    got = chunks(spark, text, 512, 64, "whitespace")
    assert time.time() - began < 20
    raw = text.encode()
    assert len(got) == 893 and all(raw[r["byte_start"] : r["byte_end"]].decode() == r["text"] and r["text"].split()[0] == f"w{448 * r['ordinal']}" for r in got)


def test_empty_text_has_no_chunk(spark):
    assert chunks(spark, " \n ", 5, 0, "whitespace") == [] and chunks(spark, " \n ", 5, 0, "structured") == []


def test_sections_bound_chunks(spark):
    got = chunks(spark, "Projects\n- built a tool\n- ran it\n\nEducation\n- a school", 50, 0, "structured")
    assert [(r["section_title"], r["split_reason"]) for r in got] == [("Projects", "section_boundary"), ("Education", "document_end")]
    assert got[0]["text"] == "Projects\n\n- built a tool\n- ran it"


def test_overlap_carries_the_last_tokens(spark):
    got = chunks(spark, "one and two.\n\nthree and four.", 4, 1, "structured")
    assert [r["text"] for r in got] == ["one and two.", "two.\n\nthree and four."]
    assert got[0]["split_reason"] == "token_limit"


def test_long_blocks_fall_into_windows(spark):
    got = chunks(spark, "a b c d e", 2, 0, "smart_sections")
    assert [(r["text"], r["split_reason"]) for r in got] == [("a b", "fallback_whitespace"), ("c d", "fallback_whitespace"), ("e", "fallback_whitespace")]
    assert [r["byte_start"] for r in got] == [0, 4, 8]


def test_bad_configurations():
    for config in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            Chunking(*config)
