"""Text functions as column expressions. Each takes and returns a Column; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries drop.
QUERY_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "did", "do", "does", "explain", "for", "from", "has", "have", "how", "i",
    "in", "is", "it", "of", "on", "or", "please", "should", "that", "the", "to", "was", "were", "what", "when", "where", "which", "who", "with", "would",
)
#: Words that embeddings drop.
EMBEDDING_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "i", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All white space of Unicode, for the inside of a character class. In expressions of columns, (?U) gives \\s this meaning.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_ALNUM = "[^\\p{L}\\p{N}]+"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def once(value: Column, f) -> Column:
    """f(value), with the value made once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalized_tokens(x: Column) -> Column:
    """Runs of letters and digits in their order, A-Z lower-cased; stop words stay."""
    return F.filter(F.split(ascii_lower(x), NOT_ALNUM), lambda t: t != "")


def query_terms(x: Column) -> Column:
    """Distinct tokens without stop words, sorted."""
    return F.array_sort(F.array_except(normalized_tokens(x), strings(QUERY_STOP_WORDS)))


def embedding_tokens(x: Column) -> Column:
    return F.array_sort(F.array_except(normalized_tokens(x), strings(EMBEDDING_STOP_WORDS)))


def normalize_text(x: Column) -> Column:
    return F.array_join(normalized_tokens(x), " ")


def split_sentences(x: Column) -> Column:
    """Pieces between . ! ? and line ends; inner white space stays."""
    return F.filter(F.split(x, "[.!?\\n]"), lambda s: s != "")


def matched_count(sentence: Column, terms: Column) -> Column:
    return F.size(F.array_intersect(terms, normalized_tokens(sentence)))


def truncate_chars(x: Column, n: int) -> Column:
    """The first n characters, with ... behind them where more follow."""
    return F.when(F.char_length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def bounded_snippet(x: Column, n: int = 280) -> Column:
    """At most n characters, the ... included."""
    return F.when(F.char_length(x) > n, F.concat(F.left(x, F.lit(n - 3)), F.lit("..."))).otherwise(x)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def best_snippet(x: Column, terms: Column, n: int = 280) -> Column:
    """The first sentence with the most distinct terms, trimmed; the whole text where no sentence has one."""
    start = F.struct(F.lit(0).alias("score"), x.alias("text"))

    def better(best: Column, s: Column) -> Column:
        score = matched_count(s, terms)
        return F.when(score > best["score"], F.struct(score.alias("score"), s.alias("text"))).otherwise(best)

    return truncate_chars(trimmed(F.aggregate(split_sentences(x), start, better, lambda b: b["text"])), n)


def text_density(x: Column) -> Column:
    """The share of letters, digits and white space; 0 for the empty text."""
    useful = F.char_length(F.regexp_replace(x, "(?U)[^\\p{L}\\p{N}\\s]+", ""))
    return F.coalesce(F.try_divide(useful.cast("double"), F.char_length(x)), F.lit(0.0))


def normalize_for_duplicate(x: Column) -> Column:
    return ascii_lower(F.btrim(F.regexp_replace(x, "(?U)\\s+", " ")))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit("(?U)\\S+"))


def is_heading_only(text: Column, section: Column) -> Column:
    """Blank, or the section's title, or at most two lines and six words without . : ;"""
    bare = trimmed(text)
    lines = F.size(F.filter(F.split(bare, "\\n"), lambda line: trimmed(line) != ""))
    short = (lines <= 2) & (word_count(bare) <= 6) & ~bare.rlike("[.:;]")
    return (bare == "") | F.coalesce(ascii_lower(bare) == ascii_lower(trimmed(section)), F.lit(False)) | short


#: Canonical section names and what they go by.
SECTION_NAMES = {
    "Summary": ("summary", "professional summary", "profile", "objective"),
    "Experience": ("experience", "work experience", "professional experience", "employment", "employment history"),
    "Projects": ("projects", "selected projects", "personal projects"),
    "Education": ("education", "academic background"),
    "Skills": ("skills", "technical skills", "core skills", "technologies"),
    "Certifications": ("certification", "certifications", "licenses"),
    "Awards": ("awards", "honors"),
    "Publications": ("publications",),
    "Leadership": ("leadership", "volunteer experience", "volunteering"),
}

BULLET = "^\\s*([-*•●◦] |[0-9]+[.)]\\s)"


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def section_heading(line: Column) -> Column:
    """The title that a trimmed line opens, or null: a canonical name, or the line itself where it looks like a heading."""
    key = ascii_lower(F.btrim(F.regexp_replace(F.regexp_replace(line, ":+$", ""), "(?U)\\s+", " ")))

    def canonical(k: Column) -> Column:
        known = F.lit(None).cast("string")
        for title, names in SECTION_NAMES.items():
            known = F.when(k.isin(*names), F.lit(title)).otherwise(known)
        return known

    words = F.filter(F.split(line, "(?U)\\s+"), lambda w: w != "")
    shouting = once(F.regexp_replace(line, "\\P{L}", ""), lambda letters: (F.char_length(letters) >= 3) & ~letters.rlike("\\P{Lu}"))

    def title_word(w: Column) -> Column:
        bare = F.regexp_replace(w, "^[()\\[\\]{}/&_-]+|[()\\[\\]{}/&_-]+$", "")
        return once(bare, lambda b: (b == "") | ascii_lower(b).isin("and", "or", "of", "for", "to", "in", "with") | b.rlike("^[\\p{Lu}\\p{N}]"))

    generic = (
        (line != "") & (F.octet_length(line) <= 80) & ~is_bullet(line) & ~line.rlike("[.,;:!?]$")
        & once(words, lambda held: F.size(held).between(1, 8) & (shouting | F.forall(held, title_word)))
    )
    return F.coalesce(once(key, canonical), F.when(generic, line))


#: Profiles in the order in which they are tried, with the substrings that mark them.
PROFILES = (
    ("research_paper", ("abstract", "references", "methodology", "doi", "arxiv")),
    ("policy_or_legal", ("policy", "agreement", "terms", "contract", "liability")),
    ("support_kb", ("faq", "support", "troubleshooting", "help center", "ticket")),
    ("technical_docs", ("api", "sdk", "readme", "endpoint", "installation", "configuration")),
    ("code_docs", ("function", "class", "module", "crate", "package", "repository")),
    ("resume", ("experience", "education", "skills", "resume", "cv")),
)


def detect_profile(text: Column, path: Column) -> Column:
    """The first profile of which the text or the path holds a mark, A-Z lower-cased. The lower-cased pair stands in a one-element
    array, so that it is made once and not for every mark."""

    def named(low: Column) -> Column:
        out = F.lit("general")
        for name, marks in reversed(PROFILES):
            met = F.lit(False)
            for mark in marks:
                met = met | F.contains(low["text"], F.lit(mark)) | F.contains(low["path"], F.lit(mark))
            out = F.when(met, F.lit(name)).otherwise(out)
        return out

    return F.element_at(F.transform(F.array(F.struct(ascii_lower(text).alias("text"), ascii_lower(path).alias("path"))), named), 1)


def document_warnings(text: Column, words: Column | None = None) -> Column:
    """words: the text's word_count, where that is at hand."""
    words = word_count(text) if words is None else words
    return F.array_compact(F.array(F.when(words < 20, F.lit("low_text_volume")), F.when(F.contains(text, F.lit("�")), F.lit("replacement_characters"))))


def extraction_quality(text: Column, words: Column | None = None) -> Column:
    words = word_count(text) if words is None else words
    return F.when((words >= 80) & ~F.contains(text, F.lit("�")), "high").when(words >= 20, "medium").otherwise("low")


def escape_markdown(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "([\\\\`*_\\[\\]<>#|])", "\\\\$1"), "[\\r\\n]+", " ")


def humanize(code: Column) -> Column:
    return F.replace(code, F.lit("_"), F.lit(" "))


def normalize_email(x: Column) -> Column:
    return F.lower(F.trim(x))


def display_name(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def exportable_context(context: Column) -> Column:
    """The entries of a map whose keys name no private content."""
    return F.map_filter(context, lambda k, v: ~k.rlike("query|prompt|answer|snippet|text|path|section"))


def file_kind(name: Column, content_type: Column) -> Column:
    """text, markdown, html, pdf or null: by extension, else by content type."""
    extension = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return (
        F.when(extension == "txt", "text").when(extension.isin("md", "markdown"), "markdown").when(extension.isin("html", "htm"), "html").when(extension == "pdf", "pdf")
        .when(kind == "text/plain", "text").when(kind == "text/markdown", "markdown").when(kind.isin("text/html", "application/xhtml+xml"), "html").when(kind == "application/pdf", "pdf")
    )


def mime_type(name: Column, content_type: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    guess = F.when(extension == "txt", "text/plain").when(extension.isin("md", "markdown"), "text/markdown").when(extension.isin("html", "htm"), "text/html").when(extension == "pdf", "application/pdf")
    return F.coalesce(F.nullif(F.trim(content_type), F.lit("")), guess, F.lit("application/octet-stream"))


def clean_file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]+)$", 1)


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments out, block ends to line ends, other tags out, common entities back."""
    x = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    x = F.regexp_replace(x, "(?i)</(p|div|li|h[1-6]|tr|title|ul|ol|table|section|article|header|footer|nav)>|<br */?>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    x = F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), " ?\\n[ \\n]*", "\n")
    return trimmed(x)
