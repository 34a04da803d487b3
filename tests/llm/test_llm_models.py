"""Language, toxicity, URLs, licenses, and the pipeline."""

import re

import pytest
from helpers import oracle, rows
from pyspark.sql import functions as F

from attestor.llm import language_id, license_scan, toxicity, url_filter
from attestor.llm.queries import OP5_SQL, OP7_SQL, queries

MEDIUM = "/root/testdata/sf0.1"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, total = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert total > 3000 and right > 0.98


def test_languages_odd_rows(odd, empty, spark):
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify_languages(odd).collect()}
    assert {(i, "und") for i in (2, 3, 4, 5, 8)} <= got and (1, "en") in got
    assert language_id.identify_languages(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.with_known_language(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 6, 7, 7, 9, 10, 11, 12, 13]


def test_families_then_pairs():
    model = language_id.fit_languages([(f"the and of with {i}", "en") for i in range(20)] + [(f"der und die nicht {i}", "de") for i in range(20)] + [(f"le la et les que {i}", "fr") for i in range(20)])
    assert model.members == {"germanic": ("de", "en"), "romance": ("fr",)}
    assert [lang for lang, _ in model.predict(["und die der", "of the and", "et que les la"])] == ["de", "en", "fr"]


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.85
    assert counts.get((0, 1), 0) / (counts[0, 0] + counts.get((0, 1), 0)) < 0.03


def test_toxicity_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 0, 0), (13, 0, 1), (None, 0, 1), (99, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(odd, labels).collect()}
    assert got[13]["predicted"] == 1 and all(got[i]["predicted"] == 0 for i in (1, 2, 3, 5, 7)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns


def test_samples_do_not_depend_on_length_or_layout(spark):
    import numpy as np

    words = {"de": "der und die nicht ist", "en": "the and of with is"}
    texts = [(i, words[lang] * (200_000 if i < 4 else 1) + f" w{i}", lang) for i in range(60) for lang in [("de", "en")[i % 2]]]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").coalesce(1)
    from attestor.llm.common import held_out

    free = docs.where(~held_out(F.col("doc_id"))).count()
    sampled, langs = language_id.training_sample(docs)
    again, langs_again = language_id.training_sample(docs.orderBy(F.desc("doc_id")).repartition(3))
    assert len(sampled) == free and sampled.packed == again.packed and list(langs) == list(langs_again)
    few, few_langs = language_id.training_sample(docs, 3)
    assert sorted(few_langs) == ["de"] * 3 + ["en"] * 3
    assert all(np.array_equal(a, b) for got, want in zip(sampled, [x for i, t, _ in texts if i in {r["doc_id"] for r in docs.where(~held_out(F.col("doc_id"))).select("doc_id").collect()} for x in language_id.count_rows([t], language_id.SIZES)], strict=True) for a, b in zip(got, want, strict=True))


def test_toxicity_sample_does_not_depend_on_length_or_layout(spark):
    from attestor.llm.common import held_out

    texts = [(i, ("harmless words " * (700_000 if i in (0, 2) else 1)) + ("grobian" if i % 2 else ""), i % 2) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int").coalesce(1)
    labels = docs.select("doc_id", "toxic")
    free = docs.where(~held_out(F.col("doc_id"))).count()
    sampled, _ = toxicity.labelled_sample(docs, labels, 1500)
    assert sampled.count() == free
    few = [{r["doc_id"] for r in toxicity.labelled_sample(d, d.select("doc_id", "toxic"), 7)[0].select("doc_id").collect()} for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(3))]
    assert few[0] == few[1] and len(few[0]) == 14
    assert any("grobian".startswith(g) for g, _, _ in toxicity.mine_entries(sampled))


def test_label_model_recovers_rates():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(200_000) < 0.2
    rates = [(0.8, 0.05), (0.7, 0.02), (0.6, 0.1), (0.9, 0.15)]
    votes = np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in rates] , 1).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a voter that repeats another
    model = toxicity.fit_label_model(len(y), votes.sum(0), votes.T @ votes, 0.2)
    assert abs(model.toxic[1] - 0.7) < 0.1 and abs(model.clean[2] - 0.1) < 0.05
    assert model.weights[0] < 0.75 and model.weights[1] > 0.8
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93


def test_posteriors_equal_enumeration():
    from itertools import product

    import numpy as np

    share, toxic, clean = 0.2, np.array([0.8, 0.6, 0.3, 0.9]), np.array([0.1, 0.05, 0.2, 0.3])
    model = toxicity.LabelModel(share, toxic, clean, np.ones(4))
    votes = np.array(list(product((0, 1), repeat=4)), float)
    joint = {}
    for y, prior, rates in ((1, share, toxic), (0, 1 - share, clean)):
        for v in votes:
            joint[y, tuple(v)] = prior * float(np.prod([r if x else 1 - r for x, r in zip(v, rates, strict=True)]))
    assert abs(sum(joint.values()) - 1) < 1e-12
    want = [joint[1, tuple(v)] / (joint[1, tuple(v)] + joint[0, tuple(v)]) for v in votes]
    assert np.allclose(model.posterior(votes), want)


def test_label_model_from_the_exact_distribution():
    """Sums over all outcomes of three independent voters and one that repeats the first: rates come back exactly, and so do weights."""
    from itertools import product

    import numpy as np

    share, toxic, clean = 0.2, (0.8, 0.6, 0.7), (0.1, 0.05, 0.2)
    sums, products = np.zeros(4), np.zeros((4, 4))
    for y, v in product((0, 1), product((0, 1), repeat=3)):
        rates = toxic if y else clean
        p = (share if y else 1 - share) * float(np.prod([r if x else 1 - r for x, r in zip(v, rates, strict=True)]))
        votes = np.array([*v, v[0]], float)
        sums += p * votes
        products += p * np.outer(votes, votes)
    model = toxicity.fit_label_model(1.0, sums, products, share)
    assert np.allclose(model.toxic, (*toxic, toxic[0]), atol=0.02) and np.allclose(model.clean, (*clean, clean[0]), atol=0.02)
    assert np.allclose(model.weights[[0, 3]], 0.55, atol=0.06) and np.allclose(model.weights[[1, 2]], 1, atol=0.01)


def test_pattern_voters_read_no_lexicon():
    lexicon = toxicity.Lexicon(tuple((w, True, 1) for w in toxicity.INSULTS))
    texts = ["I will kill you", "shut up now", "You are nothing but air", "we hate you", "what the f**k", "why?!!!", "nooooooo", "you moron", "plain words of a clean text"]
    votes = lexicon.votes(texts, lexicon.counts(texts))
    names = [{n for n, v in zip(toxicity.VOTERS, row, strict=True) if v} for row in votes]
    assert names[:7] == [{"threat"}, {"silencing"}, {"second person"}, {"hatred"}, {"masked"}, {"marks"}, {"drawn out"}] and {"insults en"} <= names[7] and not names[8]


def test_scores_equal_those_of_plain_counts(spark, small):
    """The scores of whole texts against entries counted one by one with regular expressions."""
    import numpy as np

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.collect():
        low = (r["text"] or "").lower()
        counts = np.array([len(re.findall(rf"(?<![^\W\d_]){re.escape(e)}" + (r"(?![^\W\d_])" if whole else ""), low)) for e, whole, _ in model.lexicon.entries], float)
        counts *= counts >= [need for *_, need in model.lexicon.entries]
        n = (r["text"] or "").count(" ") + 1
        x = np.concatenate([[np.log1p(counts.sum()), np.log1p((counts > 0).sum()), np.sqrt(counts.sum() / n)], np.minimum(counts, 1)])
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))) < 1e-5


def test_languages_equal_plain_votes(spark, small):
    """Families, then languages by the pairs they win, from margins summed one n-gram after another."""
    import numpy as np

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit_counted(*language_id.training_sample(docs))

    def winner(classes, machines, margins):
        classes = sorted(classes)
        score = {c: (sum((m >= 0) == (c == a) for a, b, m in machines if c in (a, b)), sum(m if c == a else -m for a, b, m in machines if c in (a, b)), c) for c in classes}
        return max(classes, key=score.get)

    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs).collect()}
    for r in docs.collect():
        if not any(map(str.isalpha, r["text"] or "")):
            assert got[r["doc_id"]] == "und"
            continue
        found, shares = next(language_id.count_rows([r["text"]], language_id.SIZES))
        margins = (model.weights[found].astype(np.float64) * shares[:, None]).sum(0)
        family = winner(model.members, [(a, b, margins[c] + bias) for a, b, c, bias in model.families], margins)
        assert got[r["doc_id"]] == winner(model.members[family], [(a, b, margins[c] + bias) for a, b, c, bias in model.languages[family]], margins)


def test_filters_keep_clashing_columns(odd, spark):
    docs = odd.withColumn("_language", F.lit("mine")).withColumn("language", F.lit("mine")).withColumn("_toxicity", F.lit("mine")).withColumn("Toxicity", F.lit("mine"))
    labels = spark.createDataFrame([(1, 0, 0), (13, 0, 1)], "doc_id long, quality int, toxic int")
    for kept in (language_id.with_known_language(docs), toxicity.without_toxic(docs, labels)):
        assert kept.columns == docs.columns and all(r["_language"] == r["language"] == r["_toxicity"] == r["Toxicity"] == "mine" for r in kept.collect())


@pytest.mark.parametrize("name,sql", [("op5_url_filter", OP5_SQL), ("op7_exact_dedup", OP7_SQL)])
def test_sql(spark, small, name, sql):
    assert rows(queries()[name](spark, small).toPandas()) == rows(oracle(small).sql(sql).df())


def test_urls_odd(spark):
    urls = [
        (1, None), (2, "no scheme"), (3, "http://EXAMPLE.com/en/7x?q"), (4, "http://a.Example.COM/en/8"), (5, "https://example.net/de/8#f"), (6, "x://notcom/en/"), (7, "http://com/en/"), (8, "http://x.org/ES/"),
        (9, "http://spam-farm.example.org/en/1"), (10, "http://a.org/b/casino/"), (11, "http://?x"), (12, "http://h"), (3, "http://EXAMPLE.com/en/7x?q"),
    ]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit(1))).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(1, 13)] == [
        (None, "allow"), (None, "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), (None, "allow"), ("com/en/", "block"), (None, "allow"),
        (None, "block"), (None, "block"), (None, "allow"), (None, "allow"),
    ]
    assert (got[3]["host"], got[3]["path"], got[11]["host"], got[12]["path"]) == ("example.com", "/en/7x", "", "")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("inline", [url_filter.INLINE_RULES, 0])
def test_url_rules_say_what_the_contract_says(spark, monkeypatch, inline):
    """Each base rule's word, as the contract lists it; a base rule that allows also wins over a block of the filter's own rules."""
    monkeypatch.setattr(url_filter, "INLINE_RULES", inline)
    urls = {
        "http://com/en/x": ("com/en/", "block"), "http://a.example.com/en/6": ("com/en/", "block"), "http://a.example.com/en/71": ("example.com/en/7", "allow"), "http://other.com/en/7": ("com/en/", "block"),
        "http://net/de/": ("net/de/", "allow"), "http://M.Example.NET/de/7": ("net/de/", "allow"), "http://other.net/de/8": ("net/de/", "allow"), "http://casino.net/de/login": ("net/de/", "allow"),
        "http://a.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.org/es/1": ("org/es/", "block"), "http://casino.net/en/login": (None, "block"),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).orderBy("page_id").collect()] == list(urls.values())
    assert [(r.name, r.action) for r in url_filter.BASE_RULES] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def test_rules_hang_on_their_rarest_token():
    rules = (url_filter.prefix_rule("block", "example.com", "/en/"),)
    assert list(url_filter.rule_index(rules, {"example": 9, "com": 9, "en": 2})) == ["en"]


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(spark, sample, odd, empty):
    extra = spark.createDataFrame([
        (1, "Under the MIT License under the mit license. CC-BY-NC 4.0 and CC BY NC"), (2, "GNU Lesser General Public License v2.1 and the GNU General Public License, version 3."),
        (3, "Licensed under the BSD 3-clause license\nSPDX-License-Identifier: Apache-2.0"), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Ünder the MIT Licenseé"),
    ], "doc_id long, text string")
    for docs in (sample, odd, extra):
        want = sorted((str(r["doc_id"]), *map(str, plain_scan(r["text"]))) for r in docs.collect())
        got = license_scan.scan_licenses(docs).collect()
        assert sorted((str(r["doc_id"]), *map(str, r[1:6])) for r in got) == want
        assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    labels = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(extra).collect()}
    assert labels[2] == "gpl-3,lgpl-2" and labels[3] == "apache-2,bsd-3" and labels[4] == "gpl-3"
    assert license_scan.scan_licenses(empty).count() == 0


def matching(pattern, rng):
    """A text that may match the pattern: its branches, repeats and white space drawn at random."""
    from re import _constants as c
    from re import _parser

    def made(items):
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                if arg[0][0] is c.NEGATE:
                    out += "x"
                    continue
                kind, value = rng.choice(arg)
                out += rng.choice(" \n") if kind is c.CATEGORY else chr(value) if kind is c.LITERAL else chr(rng.randint(*value))
            elif op is c.BRANCH:
                out += made(rng.choice(arg[1]))
            elif op is c.SUBPATTERN:
                out += made(arg[3])
            elif op is c.MAX_REPEAT:
                out += "".join(made(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
            elif op is c.ASSERT and arg[0] == 1 and rng.random() < 0.5:
                out += made(arg[1])
        return out

    return made(_parser.parse(pattern))


def plain_labels(text, rules):
    """Labels and best priority of all matches of all rules, without keywords, after priority and containment."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = {(m.start(), m.end(), r.priority, r.label) for r in rules for m in re.finditer(r.pattern, low, re.ASCII)}

    def beaten(d):
        start, stop, priority, label = d
        for a, b, p, other in found:
            if a <= start and b >= stop and (p > priority or (p == priority and ((a, b) != (start, stop) or other < label))):
                return True
        return False

    kept = [d for d in found if not beaten(d)]
    return {d[3] for d in kept}, max((d[2] for d in kept), default=0)


def test_licenses_by_every_signature(spark, sample, odd):
    import random

    rng, rules, texts = random.Random(5), license_scan.signatures(), []
    for rule in rules:
        found = {t for t in (matching(rule.pattern, rng) for _ in range(300)) if re.search(rule.pattern, t, re.ASCII)}
        assert found, rule
        assert all(any(k in t for k in rule.keyword.split("|")) and (not rule.needs or any(k in t for k in rule.needs)) for t in found), rule
        texts += sorted(found)[:2]
    texts += [" and ".join(rng.sample(texts, 4)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for some in (docs, sample, odd):
        want = []
        for r in some.collect():
            labels, best = plain_labels(r["text"], rules)
            _, n, *_, base = plain_scan(r["text"])
            want.append((str(r["doc_id"]), ",".join(sorted(labels | (set(base.split(",")) - {""}))), 1.0 if n else license_scan.WEIGHTS.get(best, 0.0)))
        assert sorted((str(r["doc_id"]), r["labels"], r["score"]) for r in license_scan.scan_licenses(some).collect()) == sorted(want)


def test_of_equal_places_the_higher_priority_stays(spark):
    rules = (license_scan.Signature("a", "word", "word", 2), license_scan.Signature("z", "word", "word", 3), license_scan.Signature("b", "wor", "word", 2))
    docs = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    assert license_scan.scan_licenses(docs, rules).first()["labels"] == "z" and license_scan.scan_licenses(docs, (rules[2], rules[0])).first()["labels"] == "a"


def test_licenses_without_a_stem(spark):
    texts = [
        ("released under the GPLv3", "gpl-3"), ("this code is GPLv3", "gpl-3"), ("LGPL v2.1", "lgpl-2"), ("distributed under the BSD", "bsd"), ("available under the EUPL", "eupl"),
        ("released under the WTFPL", "wtfpl"), ("proprietary and confidential", "proprietary"), ("all rights\nreserved", "all-rights-reserved"), ("placed into the public\ndomain", "public-domain"),
        ("creative\ncommons attribution", "cc-attribution"), ("Distributed under GPLv3 or later", "gpl-3"), ("released under the BSD-3-clause", "bsd-3"), ("available under the MPL 2.0", "mpl-2"),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert [r["labels"] for r in sorted(got)] == [label for _, label in texts]


def test_pipeline(spark, small):
    import corpus_pipeline
    from attestor.llm.common import stored

    docs = first = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, small), f"test-{name}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == first.columns and set(after) <= set(before)
        if name == "language":
            assert set(after) == {i for i, t in before.items() if t and any(map(str.isalpha, t))}
        if name == "exact":
            last = {}
            for i, t in sorted(before.items()):
                last[t] = i
            assert set(after) == set(last.values())
        if name == "near":
            from test_llm_dedup import brute

            assert set(after) == {i for i, c in brute(sorted(before.items()), 5).items() if i == c}
    assert sum(r["length"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()) == sum(r["doc_tokens"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, small).collect() if r["start"] == 0)


def test_pipeline_on_an_empty_table(spark, empty, small):
    import corpus_pipeline

    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_any_number_of_rules_gives_what_the_rules_say(spark, monkeypatch):
    rules = url_filter.BASE_RULES + url_filter.PATTERN_RULES + tuple(url_filter.prefix_rule("block" if i % 3 else "allow", f"h{i}.org", f"/x{i % 7}/") for i in range(20_000))
    urls = [(i, f"http://www.H{i * 37}.org/x{i * 37 % 7 if i % 2 else 9}/p?q") for i in range(400)] + [(i, "http://h3.org/x3/") for i in range(1000, 3000)] + [(5000, None), (5001, "no scheme"), (5002, "http://a.com/en/casino"), (5003, "http://online-casino.net"), (5003, "http://online-casino.net")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("subject", F.lit("?"))
    got = url_filter.judge_urls(pages, rules).collect()
    by = {(r["page_id"], r["host"]): (r["rule"], r["verdict"], r["method_rule"]) for r in got}
    assert len(got) == len(urls)
    for i, u in urls[:400]:
        n, fits = i * 37, i % 2 == 1 and i * 37 < 20_000
        assert by[(i, f"www.h{n}.org")] == ((f"h{n}.org/x{n % 7}/" if fits else None), ("block" if n % 3 else "allow") if fits else "allow", None)
    assert by[(1000, "h3.org")][:2] == ("h3.org/x3/", "allow") and by[(5000, "")] == (None, "allow", None) and by[(5002, "a.com")] == ("com/en/", "block", "casino") and by[(5003, "online-casino.net")][1:] == ("block", "casino")
    few, plain = url_filter.BASE_RULES + url_filter.PATTERN_RULES, sorted(map(str, url_filter.judge_urls(pages).collect()))
    monkeypatch.setattr(url_filter, "INLINE_RULES", 3)
    assert sorted(map(str, url_filter.judge_urls(pages, few).collect())) == plain
