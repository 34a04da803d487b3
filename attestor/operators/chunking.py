"""Chunking: one document gives many chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import BULLET, once, section_heading, trimmed, word_count

TARGET, OVERLAP = 512, 64
BLOCK = 64  # entries whose running sums are made together


@dataclass(frozen=True)
class Chunking:
    target: int = TARGET
    overlap: int = OVERLAP
    strategy: str = "structured"

    def __post_init__(self):
        if self.target <= 0 or not 0 <= self.overlap < self.target:
            raise ValueError("target must be positive and overlap smaller than target")

    @property
    def step(self) -> int:
        return max(1, self.target - self.overlap)


def pieces(text: Column) -> Column:
    """The text's tokens, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit("(?U)(\\s*\\S+)"), F.lit(1))


def bare(piece: Column) -> Column:
    return F.regexp_replace(piece, "(?U)^\\s+", "")


def block_sums(lengths: Column, size: int) -> Column:
    """The sums before each block of so many entries, and the sum of all at the end."""
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(lengths, s + 1, F.lit(size)), F.lit(0), lambda acc, x: acc + x))
    return F.aggregate(sums, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + b))


def running_sums(lengths: Column) -> Column:
    """The sum before each entry of a column of lengths. An array grows by copies, so entries go by blocks: the work is the number of
    entries times BLOCK, not its square."""

    def inner(before: Column, i: Column) -> Column:
        block = F.slice(lengths, i * BLOCK + 1, F.lit(BLOCK))
        sums = F.aggregate(block, F.array(before), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        return F.slice(sums, F.lit(1), F.size(block))

    return F.flatten(F.transform(block_sums(lengths, BLOCK), inner))


def token_spans(docs: DataFrame) -> DataFrame:
    """docs (with text) with a column spans: byte_start and byte_end of each token in its order."""
    rows = docs.withColumn("_pieces", pieces(F.col("text")))
    rows = rows.withColumn("_sizes", F.transform("_pieces", lambda p: F.octet_length(p))).withColumn("_before", running_sums(F.col("_sizes")))

    def span(piece: Column, i: Column) -> Column:
        end = F.get("_before", i) + F.octet_length(piece)
        return F.struct((end - F.octet_length(bare(piece))).alias("byte_start"), end.alias("byte_end"))

    return rows.withColumn("spans", F.transform("_pieces", span)).drop("_pieces", "_sizes", "_before")


def windows(docs: DataFrame, target: int, step: int) -> DataFrame:
    """docs (with text) with a column c, one row for each token window: ordinal, text, token_count, byte_start, byte_end, split_reason.

    Starts go on to the last token, so windows at the end may lie inside the one before. The text is cut into tokens
    once, bytes are summed by blocks of one step, and each window reads its own tokens: the work grows with the text.
    """
    held, starts, before = F.col("_pieces"), F.col("_starts"), F.col("_before")
    rows = docs.withColumn("_pieces", pieces(F.col("text")))
    n = F.size(held)
    rows = rows.withColumn("_starts", F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>")))
    blocks = F.transform(starts, lambda s: F.octet_length(F.array_join(F.slice(held, s + 1, F.lit(step)), "")))
    rows = rows.withColumn("_before", F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + b)))

    def cut(s: Column, i: Column) -> Column:
        raw = F.array_join(F.slice(held, s + 1, F.lit(target)), "")
        return F.struct(i.alias("ordinal"), raw.alias("raw"), F.least(F.lit(target), n - s).alias("token_count"), F.get(before, i).alias("begin"), (s + target >= n).alias("last"))

    rows = rows.withColumn("_w", F.explode(F.transform(starts, cut))).withColumn("_body", bare(F.col("_w.raw")))
    end = F.col("_w.begin") + F.octet_length("_w.raw")
    c = F.struct(
        "_w.ordinal", F.col("_body").alias("text"), "_w.token_count", (end - F.octet_length("_body")).alias("byte_start"), end.alias("byte_end"),
        F.when(F.col("_w.last"), "document_end").otherwise("token_limit").alias("split_reason"),
    )
    return rows.withColumn("c", c).drop("_pieces", "_starts", "_before", "_w", "_body")


def chunk_whitespace(docs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """docs (document_id, source_id, path, text) to chunks."""
    rows = windows(docs.select("document_id", "source_id", "path", "text"), config.target, config.step).drop("text")
    return rows.select(F.concat_ws("#", "document_id", F.col("c.ordinal").cast("string")).alias("chunk_id"), "document_id", "source_id", "path", "c.*", F.lit("whitespace").alias("strategy"), F.lit(None).cast("string").alias("section_title"))


def lines_of(text: Column) -> Column:
    """Each line of a text: body (trimmed), title (of a heading), kind (blank, heading, bullets, paragraph) and tokens."""

    def marked(body: Column) -> Column:
        title = F.when(body == "", None).otherwise(section_heading(body))
        return once(title, lambda t: F.struct(
            body.alias("body"), t.alias("title"), F.when(body == "", "blank").when(t.isNotNull(), "heading").when(body.rlike(BULLET), "bullets").otherwise("paragraph").alias("kind"),
            word_count(body).alias("tokens"),
        ))

    return F.transform(F.split(text, "\\n"), lambda raw: once(trimmed(raw), marked))


def block_starts(lines: Column) -> Column:
    """Numbers from 1 of the lines that open a block: headings, and lines of another kind than the one before; blank lines open none."""

    def opens(i: Column) -> Column:
        kind = F.element_at(lines, i)["kind"]
        return (kind != "blank") & ((kind == "heading") | (i == 1) | (F.element_at(lines, F.greatest(i - 1, F.lit(1)))["kind"] != kind))

    return F.filter(F.sequence(F.lit(1), F.size(lines)), opens)


def blocks_of(lines: Column, starts: Column) -> Column:
    """Each block: its kind, the title it sets (headings alone), first and last line that is not blank (from 0), and tokens."""

    def block(start: Column, j: Column) -> Column:
        follow = F.coalesce(F.get(starts, j + 1), F.size(lines) + 1)
        own = F.filter(F.slice(lines, start, follow - start), lambda x: x["kind"] != "blank")
        return once(own, lambda held: F.struct(
            held[0]["kind"].alias("kind"), held[0]["title"].alias("title"), (start - 1).alias("first_line"), (start + F.size(held) - 2).alias("last_line"),
            F.aggregate(held, F.lit(0), lambda acc, x: acc + x["tokens"]).alias("tokens"),
        ))

    return F.transform(starts, block)


def line_spans(docs: DataFrame) -> DataFrame:
    """document_id, line, body (trimmed), byte_start, byte_end of every line that the text has."""
    rows = docs.select("document_id", F.split("text", "\\n").alias("_raw"))
    rows = rows.withColumn("_sizes", F.transform("_raw", lambda r: F.octet_length(r) + 1)).withColumn("_before", running_sums(F.col("_sizes")))

    def span(raw: Column, i: Column) -> Column:
        begin = F.get("_before", i) + F.octet_length(raw) - F.octet_length(bare(raw))
        return once(trimmed(raw), lambda body: F.struct(body.alias("body"), begin.alias("byte_start"), (begin + F.octet_length(body)).alias("byte_end")))

    held = F.when(F.element_at("_raw", -1) == "", F.slice("_raw", F.lit(1), F.size("_raw") - 1)).otherwise(F.col("_raw"))
    return rows.withColumn("_held", held).select("document_id", F.posexplode(F.transform("_held", span)).alias("line", "c")).select("document_id", "line", "c.*")


def section_blocks(docs: DataFrame) -> DataFrame:
    """document_id, block, section_title, kind, first_line, last_line, byte_start, byte_end: headings, and runs of bullet or
    paragraph lines between blank lines, headings and changes of kind."""
    rows = docs.select("document_id", F.split("text", "\\n").alias("_raw"), lines_of(F.col("text")).alias("_lines"))
    rows = rows.withColumn("_starts", block_starts(F.col("_lines"))).withColumn("_sizes", F.transform("_raw", lambda r: F.octet_length(r) + 1))
    rows = rows.withColumns({"_blocks": blocks_of(F.col("_lines"), F.col("_starts")), "_before": running_sums(F.col("_sizes"))})
    titles = F.aggregate("_blocks", F.array().cast("array<string>"), lambda acc, b: F.array_append(acc, F.coalesce(b["title"], F.element_at(F.concat(F.array(F.lit(None).cast("string")), acc), -1))))

    def shown(b: Column, j: Column) -> Column:
        first, last = F.get("_raw", b["first_line"]), F.get("_raw", b["last_line"])
        begin = F.get("_before", b["first_line"]) + F.octet_length(first) - F.octet_length(bare(first))
        tail = F.get("_before", b["last_line"]) + F.octet_length(last) - F.octet_length(bare(last))
        return F.struct(
            F.get("_titles", j).alias("section_title"), b["kind"].alias("kind"), b["first_line"].alias("first_line"), b["last_line"].alias("last_line"), begin.alias("byte_start"),
            (tail + F.octet_length(trimmed(last))).alias("byte_end"),
        )

    return rows.withColumn("_titles", titles).select("document_id", F.posexplode(F.transform("_blocks", shown)).alias("block", "c")).select("document_id", "block", "c.*")


SPAN = "struct<begin:int,end:int,cuts:array<int>,section_title:string,split_reason:string>"


def packed(blocks: Column, target: int, overlap: int) -> Column:
    """The chunks of a row's blocks as spans of tokens, by one fold. Blocks hold all tokens of a text in their order, so a chunk is a span
    of tokens, and cuts are the starts of further blocks inside it. The state carries the open span (held from begin to at) over:
    blocks of the same section join it while there is room; else it is emitted, and inside a section its last tokens open the
    next one where the block still fits; a block beyond the target falls into windows."""
    none, no_cuts = F.array().cast(f"array<{SPAN}>"), F.array().cast("array<int>")
    step = max(1, target - overlap)
    first = F.struct(
        F.lit(False).alias("held"), F.lit(0).alias("begin"), F.lit(0).alias("at"), no_cuts.alias("cuts"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("title"),
        none.alias("done"),
    )

    def span(begin: Column, end: Column, cuts: Column, section: Column, reason: Column) -> Column:
        return F.struct(begin.alias("begin"), end.alias("end"), cuts.alias("cuts"), section.alias("section_title"), reason.alias("split_reason")).cast(SPAN)

    def fold(state: Column, block: Column) -> Column:
        at, n = state["at"], block["tokens"]
        now = F.struct(F.coalesce(block["title"], state["title"]).alias("title"), (n > target).alias("big"))

        def with_title(v: Column) -> Column:
            same = state["held"] & v["title"].eqNullSafe(state["section"])
            room = same & (at - state["begin"] + n <= target)
            tail = F.greatest(state["begin"], at - overlap)
            return F.struct(
                v["title"].alias("title"), v["big"].alias("big"), same.alias("same"), (state["held"] & (v["big"] | ~room)).alias("closes"), room.alias("room"), tail.alias("tail"),
                (same & (tail < at) & (at - tail + n <= target)).alias("carries"),
            )

        def moved(v: Column) -> Column:
            closed = F.array(span(state["begin"], at, state["cuts"], state["section"], F.when(v["same"], "token_limit").otherwise("section_boundary")))
            windows = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda w: span(at + w, at + F.least(w + target, n), no_cuts, v["title"], F.lit("fallback_whitespace")))
            done = F.when(v["closes"], F.concat(state["done"], closed)).otherwise(state["done"])
            goes_on = v["room"] | v["carries"]
            begin = F.when(v["room"], state["begin"]).when(v["carries"], v["tail"]).otherwise(at)
            cuts = F.when(v["room"], F.array_append(state["cuts"], at)).when(v["carries"], F.array_append(F.filter(state["cuts"], lambda c: c > v["tail"]), at)).otherwise(no_cuts)
            return F.struct(
                (~v["big"]).alias("held"), begin.alias("begin"), (at + n).alias("at"), F.when(v["big"], no_cuts).otherwise(cuts).alias("cuts"),
                F.when(goes_on, state["section"]).otherwise(v["title"]).alias("section"), v["title"].alias("title"), F.when(v["big"], F.concat(done, windows)).otherwise(done).alias("done"),
            )

        return once(now, lambda v: once(with_title(v), moved))

    def ended(state: Column) -> Column:
        last = F.array(span(state["begin"], state["at"], state["cuts"], state["section"], F.lit("document_end")))
        return F.when(state["held"], F.concat(state["done"], last)).otherwise(state["done"])

    return F.aggregate(blocks, first, fold, ended)


def chunk_structured(docs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """docs (document_id, source_id, path, text) to chunks along sections. Everything happens inside a document's row, in built-in
    functions: lines to blocks, a fold of blocks to spans of tokens, spans to texts. Nothing is shuffled or sorted."""
    rows = docs.select("document_id", "source_id", "path", pieces(F.col("text")).alias("_pieces"), lines_of(F.col("text")).alias("_lines"))
    rows = rows.withColumns({"_starts": block_starts(F.col("_lines")), "_sizes": F.transform("_pieces", lambda p: F.octet_length(p))})
    rows = rows.withColumns({"_blocks": blocks_of(F.col("_lines"), F.col("_starts")), "_before": block_sums(F.col("_sizes"), BLOCK)})
    rows = rows.withColumn("_spans", packed(F.col("_blocks"), config.target, config.overlap))

    def bytes_before(token: Column) -> Column:
        block = F.floor(token / BLOCK).cast("int")
        return F.get("_before", block) + F.aggregate(F.slice("_sizes", block * BLOCK + 1, token - block * BLOCK), F.lit(0), lambda acc, x: acc + x)

    def text_of(s: Column) -> Column:
        bounds = F.concat(F.array(s["begin"]), s["cuts"], F.array(s["end"]))
        part = lambda b, i: bare(F.array_join(F.slice("_pieces", F.get(b, i) + 1, F.get(b, i + 1) - F.get(b, i)), ""))
        return once(bounds, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: part(b, i)), "\n\n"))

    def shown(s: Column) -> Column:
        opening = F.get("_pieces", s["begin"])
        return F.struct(
            text_of(s).alias("text"), s["section_title"].alias("section_title"), (s["end"] - s["begin"]).alias("token_count"),
            (bytes_before(s["begin"]) + F.octet_length(opening) - F.octet_length(bare(opening))).alias("byte_start"), bytes_before(s["end"]).alias("byte_end"), s["split_reason"].alias("split_reason"),
        )

    rows = rows.select("document_id", "source_id", "path", F.posexplode(F.transform("_spans", shown)).alias("ordinal", "c"))
    return rows.select(F.concat_ws("#", "document_id", F.col("ordinal").cast("string")).alias("chunk_id"), "document_id", "source_id", "path", "ordinal", "c.*", F.lit("structured").alias("strategy"))


def chunk(docs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """smart_sections is another name of structured."""
    if config.strategy == "whitespace":
        return chunk_whitespace(docs, config)
    if config.strategy in ("structured", "smart_sections"):
        return chunk_structured(docs, config)
    raise ValueError(f"unknown chunking strategy {config.strategy}")
