"""License scans with ordered signature rules.

A rule has keywords, words that it needs besides, a regular expression on the lower-cased text, a label and a
priority. Its expression runs only where the text contains one of its keywords and one of the words it needs; whatever
the expression matches contains both, so nothing is lost. Detections are ordered by their start, the longest first and
among equal places that of the highest priority; one that lies inside a detection of higher priority, or inside a
longer one of equal priority, is suppressed, which resolves overlapping names (``lesser general public license`` holds
``general public license``). Of detections with equal places and priorities the first label of the alphabet stays.
Three base phrases are counted besides, word by word.

Everything is built-in column functions on one row, so nothing is shuffled. Where one document has m
detections, their list takes time that grows as m squared; at ten thousand detections that is under a second.

Defined results: null text counts as empty (no words, no labels, score 0); repeated rows get equal answers; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import lower_ascii

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same words before lower-casing.
WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

SEP = "[\\s,;:()/_-]+"
OPT = "[\\s,;:()/_-]*"

#: Of these a text with a grant, or with a name and the word license behind it, contains one.
GRANT_WORDS = ("licen", "released", "distributed", "available", "provided", "published", "covered", "redistribut")
LICENSE_WORDS = ("licen",)

#: label, expression of the name, keywords of which any text with the name contains one (divided by |), SPDX identifiers.
FAMILIES = (
    ("mit", f"(?:the{SEP})?mit(?:/x11|/expat)?", "mit", "mit"),
    ("mit-0", f"mit{SEP}no{SEP}attribution", "attribution", "mit-0"),
    ("apache-1", f"apache{SEP}(?:software{SEP})?licen[cs]e{SEP}(?:version{SEP}|v\\.?{OPT})?1(?:\\.[01])?", "apache", "apache-1\\.[01]"),
    ("apache-2", f"apache{SEP}(?:software{SEP})?licen[cs]e{SEP}(?:version{SEP}|v\\.?{OPT})?2(?:\\.0)?", "apache", "apache-2\\.0"),
    ("apache", f"apache{SEP}(?:software{SEP})?(?=licen[cs]e)", "apache", "apache"),
    ("gpl-1", f"(?:gnu{SEP})?(?:general{SEP}public{SEP}licen[cs]e|gpl){OPT}(?:version{SEP}|v\\.?{OPT})1(?:\\.0)?(?![0-9]|\\.[0-9])", "gpl|general", "gpl-1\\.0(?:-only|-or-later|\\+)?"),
    ("gpl-2", f"(?:gnu{SEP})?(?:general{SEP}public{SEP}licen[cs]e|gpl){OPT}(?:version{SEP}|v\\.?{OPT})2(?:\\.0)?(?![0-9]|\\.[0-9])", "gpl|general", "gpl-2\\.0(?:-only|-or-later|\\+)?"),
    ("gpl-3", f"(?:gnu{SEP})?(?:general{SEP}public{SEP}licen[cs]e|gpl){OPT}(?:version{SEP}|v\\.?{OPT})3(?:\\.0)?(?![0-9]|\\.[0-9])", "gpl|general", "gpl-3\\.0(?:-only|-or-later|\\+)?"),
    ("gpl", f"(?:gnu{SEP}general{SEP}public|gnu{SEP}gpl|(?<![a-z])gpl)", "gpl|general", "gpl"),
    ("lgpl-2", f"(?:gnu{SEP})?(?:(?:lesser|library){SEP}general{SEP}public{SEP}licen[cs]e|lgpl){OPT}(?:version{SEP}|v\\.?{OPT})2(?:\\.[01])?", "lgpl|general", "lgpl-2\\.[01](?:-only|-or-later|\\+)?"),
    ("lgpl-3", f"(?:gnu{SEP})?(?:lesser{SEP}general{SEP}public{SEP}licen[cs]e|lgpl){OPT}(?:version{SEP}|v\\.?{OPT})3(?:\\.0)?", "lgpl|general", "lgpl-3\\.0(?:-only|-or-later|\\+)?"),
    ("lgpl", f"(?:gnu{SEP})?(?:(?:lesser|library){SEP}general{SEP}public|lgpl)", "lgpl|general", "lgpl"),
    ("agpl-3", f"(?:gnu{SEP})?(?:affero{SEP}general{SEP}public{SEP}licen[cs]e|agpl){OPT}(?:version{SEP}|v\\.?{OPT})3(?:\\.0)?", "agpl|affero", "agpl-3\\.0(?:-only|-or-later|\\+)?"),
    ("agpl", f"(?:gnu{SEP})?(?:affero{SEP}general{SEP}public|agpl)", "agpl|affero", "agpl"),
    ("fdl", f"(?:gnu{SEP})?free{SEP}documentation", "documentation", "gfdl-1\\.[123](?:-only|-or-later)?"),
    ("bsd-0", f"(?:zero{SEP}clause|0{SEP}clause){SEP}bsd|bsd{SEP}zero{SEP}clause", "bsd", "0bsd"),
    ("bsd-2", f"(?:simplified{SEP}bsd|freebsd|bsd{SEP}2{SEP}clause|(?:2|two){SEP}clause{SEP}bsd)", "bsd", "bsd-2-clause(?:-patent)?"),
    ("bsd-3", f"(?:new{SEP}bsd|modified{SEP}bsd|revised{SEP}bsd|bsd{SEP}3{SEP}clause|(?:3|three){SEP}clause{SEP}bsd)", "bsd", "bsd-3-clause(?:-clear)?"),
    ("bsd-4", f"(?:original{SEP}bsd|bsd{SEP}4{SEP}clause|(?:4|four){SEP}clause{SEP}bsd)", "bsd", "bsd-4-clause"),
    ("bsd", "(?<![a-z])bsd", "bsd", "bsd"),
    ("mpl-1", f"mozilla{SEP}public{SEP}licen[cs]e{SEP}(?:version{SEP}|v\\.?{OPT})?1\\.[01]", "mozilla", "mpl-1\\.[01]"),
    ("mpl-2", f"mozilla{SEP}public{SEP}licen[cs]e{SEP}(?:version{SEP}|v\\.?{OPT})?2(?:\\.0)?", "mozilla", "mpl-2\\.0"),
    ("mpl", f"(?:mozilla{SEP}public|(?<![a-z])mpl)", "mozilla|mpl", "mpl"),
    ("epl-1", f"eclipse{SEP}public{SEP}licen[cs]e{SEP}(?:version{SEP}|v\\.?{OPT})?1(?:\\.0)?", "eclipse", "epl-1\\.0"),
    ("epl-2", f"eclipse{SEP}public{SEP}licen[cs]e{SEP}(?:version{SEP}|v\\.?{OPT})?2(?:\\.0)?", "eclipse", "epl-2\\.0"),
    ("edl", f"eclipse{SEP}distribution", "eclipse", "edl-1\\.0"),
    ("cddl", f"common{SEP}development{SEP}and{SEP}distribution", "distribution", "cddl-1\\.[01]"),
    ("cpl", f"common{SEP}public(?={SEP}licen[cs]e)", "common", "cpl-1\\.0"),
    ("ipl", f"ibm{SEP}public", "ibm", "ipl-1\\.0"),
    ("isc", "(?<![a-z])isc", "isc", "isc"),
    ("zlib", "zlib(?:/libpng)?", "zlib", "zlib"),
    ("boost", f"boost{SEP}software", "boost", "bsl-1\\.0"),
    ("bsl", f"business{SEP}source", "business", "busl-1\\.1"),
    ("sspl", f"server{SEP}side{SEP}public", "server", "sspl-1\\.0"),
    ("elastic", "elastic", "elastic", "elastic-2\\.0"),
    ("unlicense", "(?<![a-z])unlicense", "unlicense", "unlicense"),
    ("wtfpl", f"(?:wtfpl|do{SEP}what{SEP}the{SEP}f[a-z*]+{SEP}you{SEP}want)", "wtfpl|what", "wtfpl"),
    ("artistic-1", f"artistic{SEP}licen[cs]e{SEP}(?:version{SEP}|v\\.?{OPT})?1(?:\\.0)?", "artistic", "artistic-1\\.0(?:-perl)?"),
    ("artistic-2", f"artistic{SEP}licen[cs]e{SEP}(?:version{SEP}|v\\.?{OPT})?2(?:\\.0)?", "artistic", "artistic-2\\.0"),
    ("artistic", "artistic", "artistic", "artistic"),
    ("python", f"python{SEP}software{SEP}foundation", "python", "(?:psf|python)-2\\.0"),
    ("php", f"(?<![a-z])php(?={SEP}licen[cs]e)", "php", "php-3\\.01?"),
    ("ruby", f"(?<![a-z])ruby(?={SEP}licen[cs]e)", "ruby", "ruby"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ofl", f"(?:sil{SEP})?open{SEP}font", "font", "ofl-1\\.[01]"),
    ("ncsa", f"(?:university{SEP}of{SEP}illinois{SEP}/?{OPT})?ncsa", "ncsa", "ncsa"),
    ("eupl", f"(?:european{SEP}union{SEP}public|eupl)", "eupl|european", "eupl-1\\.[012]"),
    ("cecill", "cecill", "cecill", "cecill-[12bc](?:\\.[01])?"),
    ("osl", f"open{SEP}software(?={SEP}licen[cs]e)", "software", "osl-[123]\\.[01]"),
    ("afl", f"academic{SEP}free", "academic", "afl-[123]\\.[012]"),
    ("ms-pl", f"microsoft{SEP}public", "microsoft", "ms-pl"),
    ("ms-rl", f"microsoft{SEP}reciprocal", "microsoft", "ms-rl"),
    ("odbl", f"open{SEP}(?:data{SEP}commons{SEP}open{SEP})?database", "database", "odbl-1\\.0"),
    ("pddl", f"public{SEP}domain{SEP}dedication", "dedication", "pddl-1\\.0"),
    ("cc0", f"(?<![a-z])cc{OPT}(?:0|zero)(?![0-9])(?:{OPT}1\\.0)?", "cc", "cc0-1\\.0"),
    ("cc-by-nc-nd", f"(?<![a-z])cc{SEP}by{SEP}nc{SEP}nd(?:{OPT}[1-4]\\.[05])?", "cc", "cc-by-nc-nd-[1-4]\\.[05]"),
    ("cc-by-nc-sa", f"(?<![a-z])cc{SEP}by{SEP}nc{SEP}sa(?:{OPT}[1-4]\\.[05])?", "cc", "cc-by-nc-sa-[1-4]\\.[05]"),
    ("cc-by-nc", f"(?<![a-z])cc{SEP}by{SEP}nc(?![a-z])(?:{OPT}[1-4]\\.[05])?", "cc", "cc-by-nc-[1-4]\\.[05]"),
    ("cc-by-nd", f"(?<![a-z])cc{SEP}by{SEP}nd(?:{OPT}[1-4]\\.[05])?", "cc", "cc-by-nd-[1-4]\\.[05]"),
    ("cc-by-sa", f"(?<![a-z])cc{SEP}by{SEP}sa(?:{OPT}[1-4]\\.[05])?", "cc", "cc-by-sa-[1-4]\\.[05]"),
    ("cc-by", f"(?<![a-z])cc{SEP}by(?![a-z])(?:{OPT}[1-4]\\.[05])?", "cc", "cc-by-[1-4]\\.[05]"),
    ("cc-attribution-sharealike", f"creative{SEP}commons{SEP}attribution{SEP}share{OPT}alike", "commons", "cc-sa-1\\.0"),
    ("cc-attribution-noncommercial", f"creative{SEP}commons{SEP}attribution{SEP}non{OPT}commercial", "commons", "cc-nc-1\\.0"),
    ("cc-attribution", f"creative{SEP}commons{SEP}attribution", "commons", "cc-attribution"),
)

#: Abbreviations with a version, which count in a grant or before the word license.
SHORT = {
    "mpl-1": f"mpl{OPT}(?:version{SEP}|v\\.?{OPT})?1\\.[01]", "mpl-2": f"mpl{OPT}(?:version{SEP}|v\\.?{OPT})?2(?:\\.0)?",
    "epl-1": f"epl{OPT}(?:version{SEP}|v\\.?{OPT})?1(?:\\.0)?", "epl-2": f"epl{OPT}(?:version{SEP}|v\\.?{OPT})?2(?:\\.0)?",
    "cddl": f"cddl(?:{OPT}(?:version{SEP}|v\\.?{OPT})?1\\.[01])?", "sspl": f"sspl(?:{OPT}(?:version{SEP}|v\\.?{OPT})?1)?",
    "osl": f"osl{SEP}[123]\\.[01]", "afl": f"afl{SEP}[123]\\.[012]", "apache-2": f"apache{SEP}(?:v\\.?{OPT})?2\\.0", "apache-1": f"apache{SEP}(?:v\\.?{OPT})?1\\.[01]",
}
#: Names that say enough by their version alone, and what a text with one contains besides its keyword.
NUMBERED = {label: () for label in ("gpl-1", "gpl-2", "gpl-3", "lgpl-2", "lgpl-3", "agpl-3")} | {
    label: LICENSE_WORDS for label in ("apache-1", "apache-2", "mpl-1", "mpl-2", "epl-1", "epl-2", "artistic-1", "artistic-2")
}

#: Sentences of the licenses themselves.
BODIES = (
    ("mit", "permission\\s+is\\s+hereby\\s+granted,\\s+free\\s+of\\s+charge,\\s+to\\s+any\\s+person\\s+obtaining\\s+a\\s+copy", "hereby"),
    ("boost", "permission\\s+is\\s+hereby\\s+granted,\\s+free\\s+of\\s+charge,\\s+to\\s+any\\s+person\\s+or\\s+organi[sz]ation", "hereby"),
    ("isc", "permission\\s+to\\s+use,\\s+copy,\\s+modify,\\s+and(?:/or)?\\s+distribute\\s+this\\s+software\\s+for\\s+any\\s+purpose\\s+with\\s+or\\s+without\\s+fee", "permission"),
    ("bsd", "redistribution\\s+and\\s+use\\s+in\\s+source\\s+and\\s+binary\\s+forms,\\s+with\\s+or\\s+without\\s+modification", "redistribution"),
    ("bsd-3", "neither\\s+the\\s+names?\\s+of\\s+[^.]{1,120}\\s+may\\s+be\\s+used\\s+to\\s+endorse\\s+or\\s+promote", "endorse"),
    ("bsd-4", "all\\s+advertising\\s+materials\\s+mentioning\\s+features\\s+or\\s+use\\s+of\\s+this\\s+software", "advertising"),
    ("gpl", "is\\s+free\\s+software[:;,]?\\s+you\\s+can\\s+redistribute\\s+it\\s+and/or\\s+modify", "redistribute"),
    ("apache-2", "may\\s+not\\s+use\\s+this\\s+file\\s+except\\s+in\\s+compliance\\s+with\\s+the\\s+licen[cs]e", "compliance"),
    ("mpl-2", "this\\s+source\\s+code\\s+form\\s+is\\s+subject\\s+to\\s+the\\s+terms\\s+of\\s+the\\s+mozilla\\s+public", "mozilla"),
    ("unlicense", "this\\s+is\\s+free\\s+and\\s+unencumbered\\s+software\\s+released\\s+into\\s+the\\s+public\\s+domain", "unencumbered"),
    ("zlib", "the\\s+origin\\s+of\\s+this\\s+software\\s+must\\s+not\\s+be\\s+misrepresented", "misrepresented"),
    ("wtfpl", "everyone\\s+is\\s+permitted\\s+to\\s+copy\\s+and\\s+distribute\\s+verbatim\\s+or\\s+modified\\s+copies", "verbatim"),
    ("cc0", "waived?\\s+all\\s+copyright\\s+and\\s+related\\s+or\\s+neighbou?ring\\s+rights", "copyright"),
)

#: Notices that are no named license.
NOTICES = (
    ("all-rights-reserved", "all\\s+rights\\s+reserved", "rights", 1),
    ("copyright-notice", "copyright\\s+(?:\\(c\\)|©)?\\s*[0-9]{4}", "copyright", 1),
    ("public-domain", "(?:released|placed|dedicated)\\s+(?:in)?to\\s+the\\s+public\\s+domain", "public", 2),
    ("warranty-disclaimer", "provided\\s+[\"'“]?as\\s+is[\"'”]?,?\\s+without\\s+warranty", "warranty", 1),
    ("proprietary", "proprietary\\s+and\\s+confidential", "proprietary", 2),
)

WEIGHTS = {4: 1.0, 3: 0.95, 2: 0.7, 1: 0.3}


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int
    needs: tuple[str, ...] = ()


def signatures() -> tuple[Signature, ...]:
    """The rules: for each family a grant, a titled name, a name with its version, an SPDX line and a link, then sentences and notices."""
    grant = f"(?:licen[cs]ed|released|distributed|available|provided|published|covered|redistribut(?:ed|able)){SEP}(?:(?:only|as|is|are){SEP})*(?:under|by|with){SEP}(?:the{SEP}terms{SEP}of{SEP})?(?:the{SEP}|an?{SEP})?"
    rules = []
    for label, full, keyword, spdx in FAMILIES:
        name, title = full, f"(?:{OPT}licen[cs]e)?"
        if label in SHORT:
            name, keyword = f"{full}|(?<![a-z]){SHORT[label]}", f"{keyword}|{label.split('-')[0]}"
        rules += [
            Signature(label, keyword, f"(?<![a-z0-9]){grant}(?:{name}){title}(?![a-z0-9])", 4, GRANT_WORDS),
            Signature(label, "spdx-license-identifier", f"spdx-license-identifier:\\s*(?:{spdx})(?![a-z0-9.])", 3),
            Signature(label, "licenses/", f"(?:opensource|spdx|gnu|creativecommons|choosealicense)\\.(?:org|com)/licenses/(?:{spdx})(?![a-z0-9])", 3),
        ]
        if label.startswith("cc"):
            rules.append(Signature(label, keyword, f"(?:{name})", 2))
        else:
            rules.append(Signature(label, keyword, f"(?<![a-z0-9])(?:{name}){OPT}(?:public{SEP})?licen[cs]e(?![a-z0-9])", 2, LICENSE_WORDS))
        if label in NUMBERED:
            rules.append(Signature(label, keyword, f"(?<![a-z0-9])(?:{full})(?![a-z0-9])", 2, NUMBERED[label]))
    rules += [Signature(label, keyword, pattern, 3) for label, pattern, keyword in BODIES]
    return tuple(rules) + tuple(Signature(label, keyword, pattern, priority) for label, pattern, keyword, priority in NOTICES)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_places(joined: Column, phrase: str) -> Column:
    """(n, first, last): places of the phrase in words joined, led and closed by single spaces; starts count words."""
    parts = F.split(joined, f" {phrase}(?= )", -1)
    n, words = F.size(parts) - 1, phrase.count(" ") + 1
    return F.struct(
        n.alias("n"),
        F.when(n > 0, _spaces(F.get(parts, F.lit(0)))).alias("first"),
        F.when(n > 0, _spaces(joined) - _spaces(F.get(parts, n)) - words).alias("last"),
    )


def detections(low: Column, rules: tuple[Signature, ...]) -> Column:
    """All matches of the rules whose words the text contains: (start, back, rank, label), where back and rank are the end and
    the priority negated; by start, the longest first, of those the highest priority."""

    def literal(r: Signature) -> Column:
        return F.struct(F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"))

    def places(rule: Column) -> Column:
        matched = F.regexp_extract_all(low, rule["pattern"], F.lit(0))
        between = F.split(low, rule["pattern"], -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,back:int,rank:int,label:string>>").alias("found"))

        def step(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + F.length(pair["between"])
            stop = begin + F.length(pair["matched"])
            return F.struct(stop.alias("at"), F.array_append(acc["found"], F.struct(begin.alias("start"), (-stop).alias("back"), (-rule["priority"]).alias("rank"), rule["label"].alias("label"))).alias("found"))

        pairs = F.zip_with(F.slice(between, 1, F.size(matched)), matched, lambda b, m: F.struct(b.alias("between"), m.alias("matched")))
        return F.when(F.size(matched) > 0, F.aggregate(pairs, start, step, lambda acc: acc["found"])).otherwise(start["found"])

    groups: dict[tuple[str, ...], dict[str, list[Signature]]] = {}
    for r in rules:
        groups.setdefault(r.needs, {}).setdefault(r.keyword, []).append(r)

    def behind(held: dict[str, list[Signature]]) -> Column:
        """The rules of the keywords that stand in the text; each keyword is looked up once for all of its rules."""
        some = [F.struct(F.array(*[F.lit(k) for k in keyword.split("|")]).alias("keywords"), F.array(*map(literal, of)).alias("rules")) for keyword, of in held.items()]
        return F.flatten(F.transform(F.filter(F.array(*some), lambda g: F.exists(g["keywords"], lambda k: F.contains(low, k))), lambda g: g["rules"]))

    none = F.filter(F.array(literal(rules[0])), lambda r: F.lit(False))
    chosen = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in needs]), behind(held)).otherwise(none) if needs else behind(held) for needs, held in groups.items()]
    return F.array_sort(F.flatten(F.transform(F.flatten(F.array(*chosen)), places)))


def unsuppressed(found: Column) -> Column:
    """(priority, label) of the detections that lie in none of higher priority, nor in a longer one of equal priority.

    found is ordered by start, longest first, so whatever contains a detection stands before it, and for each
    priority only the furthest end so far matters.
    """
    zero = F.struct(*[F.lit(0).alias(f"end{p}") for p in WEIGHTS], F.array().cast("array<struct<priority:int,label:string>>").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        stop, priority = -d["back"], -d["rank"]
        inside = reduce(lambda a, b: a | b, [(acc[f"end{p}"] >= stop) & (F.lit(p) >= priority) for p in WEIGHTS])
        ends = [F.when(priority == p, F.greatest(acc[f"end{p}"], stop)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in WEIGHTS]
        kept = F.when(inside, acc["kept"]).otherwise(F.array_union(acc["kept"], F.array(F.struct(priority.alias("priority"), d["label"].alias("label")))))
        return F.struct(*ends, kept.alias("kept"))

    return F.aggregate(found, zero, step, lambda acc: acc["kept"])


def scan_licenses(docs: DataFrame, rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs (doc_id, text)."""
    rules = rules or signatures()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), lower_ascii(text).alias("low"))
    # A base phrase can only stand in a text that contains each of its words.
    may_hold = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains("low", F.lit(w)) for w in sorted(p.split(), key=len, reverse=True)]) for p in BASE_PHRASES])
    words = F.when(may_hold, F.filter(F.split("low", NOT_WORD), lambda w: w != ""))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    rows = rows.select("doc_id", "n_words", "low", *[base_places(F.col("joined"), p).alias(f"base{i}") for i, p in enumerate(BASE_PHRASES)])
    rows = rows.withColumn("kept", unsuppressed(detections(F.col("low"), rules)))
    places = [F.col(f"base{i}") for i in range(len(BASE_PHRASES))]
    base = F.array_compact(F.array(*[F.when(b["n"] > 0, F.lit(label)) for b, label in zip(places, BASE_PHRASES.values(), strict=True)]))
    own = F.transform("kept", lambda k: k["label"])
    n_base = reduce(lambda a, b: a + b, [F.coalesce(b["n"], F.lit(0)) for b in places]).cast("long")
    weight = F.array_max(F.transform("kept", lambda k: reduce(lambda c, p: c.when(k["priority"] == p, F.lit(WEIGHTS[p])), WEIGHTS, F.when(F.lit(False), F.lit(0.0)))))
    return rows.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.least(*[b["first"] for b in places]).cast("long").alias("first_word"), F.greatest(*[b["last"] for b in places]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(weight, F.lit(0.0))).alias("score"),
    )
