"""Quality rules, licence scan, line dedup, url filters."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkgraph.llm import license_scan, line_dedup, quality_rules, url_filters
from linkgraph.llm.common import LOWER, UPPER
from linkgraph.llm.license_texts import TEMPLATES

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").encode().split()


def test_counts_match_brute_force(spark, odd_docs, tiny):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text"))
    for row in docs.select("text", quality_rules.counted(F.col("text")).alias("c")).collect():
        text, ws = row["text"] or "", words_of(row["text"])
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        places = {j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        assert row["c"]["n_words"] == len(ws)
        assert row["c"]["word_chars"] == sum(len(w.decode()) for w in ws)
        assert row["c"]["n_symbols"] == sum(text.count(x) for x in "#*$%&|<>")
        assert row["c"]["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["c"]["n_repeat_words"] == len(places)


def prose(i, marks=0, letters=5):
    """Sixty words of about ``letters`` letters, with some more or less by ``i``, of which ``marks`` carry a mark."""
    words = [f"{chr(97 + (i + k) % 26)}{chr(97 + (i * k) % 26)}" * (letters // 2) + "x" * ((i + k) % 3) for k in range(60)]
    return " ".join(w + ("|" if k < marks + i % 4 else "") for k, w in enumerate(words))


def brute_verdicts(rows):
    """{position: failed rates} of (lang, source, text) rows that all pass the base rules."""
    rates = []
    for _, _, text in rows:
        ws = text.split()
        chars = sum(map(len, ws))
        marks = sum(ord(c) < 128 and not c.isalpha() for w in ws for c in w)
        points, capitals = sum(text.count(c) for c in ".,;:!?"), sum("A" <= c <= "Z" for c in text)
        n = len(ws)
        rates.append((marks * 1000 // chars, chars * 100 // n, points * 1000 // n, capitals * 1000 // n, len(set(ws)) * 1000 // n))
    size, small = Counter((a, b) for a, b, _ in rows), Counter()
    for (lang, source), n in size.items():
        small[lang] += n if n < quality_rules.SMALL else 0

    def pool(lang, source):
        if size[lang, source] >= quality_rules.SMALL:
            return lang, source
        return (lang, "*") if small[lang] >= quality_rules.SMALL else None

    def quartiles(values):
        ordered = sorted(v if v < 256 else v >> (v.bit_length() - 8) << (v.bit_length() - 8) for v in values)
        return ordered[-(-len(ordered) // 4) - 1], ordered[-(-3 * len(ordered) // 4) - 1]

    found = {}
    for i, (lang, source, _) in enumerate(rows):
        failed = []
        for k, name in enumerate(quality_rules.RATES):
            home = pool(lang, source)
            low, high = quartiles([r[k] for r, (a, b, _) in zip(rates, rows) if home in (None, pool(a, b))])
            q1, q3 = quartiles([r[k] for r, (a, _, _) in zip(rates, rows) if a == lang])
            reach = quality_rules.SPREAD * max(high - low, q3 - q1) + max(1, high >> 7)
            if not low - reach <= rates[i][k] <= high + reach:
                failed.append(name)
        found[i] = failed
    return found


def test_thresholds_follow_the_source(spark):
    rows = [("en", "prose", prose(3, 30)), ("en", "tables", prose(3, 30)), ("de", None, prose(5, letters=12)), ("en", "prose", prose(5, letters=12))]
    rows += [("en", "prose", prose(i)) for i in range(300)] + [("en", "tables", prose(i, 30)) for i in range(60)]
    rows += [("de", None, prose(i, letters=12)) for i in range(60)] + [("en", "prose", prose(3, 12)), ("de", None, prose(5))]
    rows += [("de", f"few{i % 9}", prose(i, 4)) for i in range(70)] + [("xx", "one", prose(i, 9)) for i in range(5)] + [(None, "y", prose(9))]
    df = spark.createDataFrame([(i, a, b, t) for i, (a, b, t) in enumerate(rows)], "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: r["failed_rates"] for r in quality_rules.quality_verdicts(df).collect()}
    assert got == brute_verdicts(rows)
    assert "marks" in got[0] and got[1] == []  # one text, two sources
    assert got[2] == [] and "length" in got[3]
    rated = quality_rules.rate_documents(df).where("not base_failed")
    limits = {(r["lang"], r["source"]): r for r in quality_rules.thresholds(quality_rules.sketches(rated)).collect()}
    for name in ("marks", "length"):
        assert len({r[f"high_{name}"] for r in limits.values()}) > 2


def test_copies_do_not_narrow_a_source(spark):
    rows = [(i, "en", f"s{i % 3}", prose(i)) for i in range(300)] + [(1000 + i, "en", "s0", prose(7)) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    assert quality_rules.quality_verdicts(df).where("not kept").count() == 0


def test_sketches_merge_and_bound_the_error(spark):
    values = spark.range(5000).selectExpr("'en' AS lang", "'s' AS source", *(f"id * 7 AS r_{n}" for n in quality_rules.RATES))
    bins = quality_rules.sketches(values).where("rate = 'marks'").collect()
    assert sum(r["n"] for r in bins) == 5000 and len(bins) < 256 + 128 * 8
    assert all(r["bin"] < 256 or r["bin"] % 2 ** (r["bin"].bit_length() - 8) == 0 for r in bins)
    halves = quality_rules.sketches(values.where("r_marks % 2 = 0")).unionByName(quality_rules.sketches(values.where("r_marks % 2 = 1")))
    assert quality_rules.thresholds(halves).collect() == quality_rules.thresholds(quality_rules.sketches(values)).collect()


def test_keep_good_returns_whole_rows(make_docs, odd_docs, no_docs):
    good = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([(1, good), (1, good), (2, "short"), (None, good), (3, None)])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1]
    assert quality_rules.keep_good(no_docs).count() == 0
    assert quality_rules.quality_verdicts(odd_docs).count() == odd_docs.count()


def brute_lines(rows):
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = line.strip(SPACES)
            k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
            if len(k) >= 20:
                held.setdefault(k, set()).add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            k = line.strip(SPACES)
            k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
            ids = held.get(k, ())
            if len(k) < 20 or len(ids) < 3 or max(ids) == (-(2**63) if doc is None else doc):
                kept.append(line)
        out.append((str(doc), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_match_brute_force(make_docs, odd_docs):
    common, other = "This line stands in several documents.", "Ä line that is not as common as that one"
    rows = [(i, f"\t{common.upper() if i % 2 else common} \nown {i}\n{common}") for i in range(5)]
    rows += [(1, f"{other}\n\nsecond text of this id\n{common}"), (7, other), (8, None), (9, ""), (None, f"x\n{common}")]
    rows += [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = line_dedup.clean_lines(make_docs(rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute_lines(rows)


def test_lines_of_nothing(no_docs):
    assert line_dedup.clean_lines(no_docs).count() == 0


def brute_notices(text):
    """(labels of templates, best share) by looking at each run of words as long as a template."""
    ws = [w for w in re.split(license_scan.SEPARATORS, (text or "").translate(str.maketrans(UPPER, LOWER))) if w]
    found = {}
    for label, template in TEMPLATES:
        wanted = set(license_scan.template_words(template))
        length = len([w for w in re.split(license_scan.SEPARATORS, template.lower()) if w])
        best = max(len(wanted & set(ws[i : i + length])) for i in range(max(1, len(ws) - length + 1)))
        if 5 * best >= 4 * len(wanted):
            found[label] = max(best / len(wanted), found.get(label, 0.0))
    return ",".join(sorted(found)), max(found.values(), default=0.0)


FILLER = " ".join(f"z{i}" for i in range(90))
MIT = "permission is hereby granted to any person obtaining a copy of this software and associated documentation files free of charge to deal in the software without restriction"


def test_licences_keep_base_and_find_variants(make_docs, odd_docs, no_docs):
    rows = [
        (1, "Licensed under  the APACHE license; version 2 only."),
        (2, f"{FILLER} cc-by and CC BY\nall rights, reserved {FILLER}"),
        (3, f"{FILLER} {MIT} {FILLER}"),
        (4, f"released {FILLER} under {FILLER} the mit license"),
        (5, None),
        (6, "gnu general public licence"),
        (7, "Released under the BSD license"),
        (1, "general Public\n\nLicense"),
    ]
    got = [tuple(r) for r in license_scan.scan(make_docs(rows)).collect()]
    by = {(r[0], r[1]): r[2:] for r in got}
    assert by[(1, 8)][0] == 0 and by[(1, 8)][3:] == ("", "apache", 1.0)
    assert by[(2, 188)] == (3, 90, 95, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert by[(3, 207)][4] == "mit"
    assert by[(4, 185)][3:] == ("", "mit", 1.0)
    assert by[(7, 5)][3:] == ("", "bsd", 1.0)
    assert by[(5, 0)] == (0, None, None, "", "", 0.0)
    assert by[(6, 4)][3:] == ("", "", 0.0)
    assert by[(1, 3)] == (1, 0, 0, "gpl", "gpl", 1.0)
    assert license_scan.scan(odd_docs).count() == odd_docs.count()
    assert license_scan.scan(no_docs).count() == 0


@pytest.mark.parametrize(
    "text, base, labels",
    [
        ("Released under the Apache License", "", "apache"),
        ("Released under the ISC License", "", "isc"),
        ("Licensed under the Mozilla Public License, Version 2.0", "", "mpl"),
        ("Licensed under CC BY 4.0", "cc-by", "cc-by"),
        ("Licensed under CC BY-NC 4.0", "cc-by", "cc-by,cc-by-nc"),
        ("Released under the GNU General Public License", "gpl", "gpl"),
        ("The film was released in spring; under the old license it ran.", "", ""),
        ("Redistribution and use in source and binary forms are permitted provided that the above copyright notice and\n"
         "this paragraph are duplicated in all such forms", "", "bsd"),
        ("Creative Commons Attribution-NonCommercial 4.0 International", "", "cc-by-nc"),
        ("It may be used without any license, by any person and for any purpose, and copies are free of charge.", "", ""),
    ],
)
def test_a_licence_gets_its_own_label(make_docs, text, base, labels):
    row = license_scan.scan(make_docs([(1, text)])).first()
    assert (row["base_labels"], row["labels"]) == (base, labels)


def test_wrapped_licences_are_found(make_docs):
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted"
    mit = MIT.replace("to any person", "to any\nperson")
    lines = "\n".join(" ".join(f"z{i}x{k}" for k in range(9)) for i in range(12))
    long = f"redistribution and use {'y ' * 50} in source and binary forms with or without modification"
    docs = make_docs([(1, bsd), (2, mit), (3, f"{lines}\n{bsd}\n{lines}"), (4, f"{'q ' * 20}\n{long}"), (5, lines),
                      (6, "mit einer im dem\nund released der\nunter dem\nunder the z\nlicense")])
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs).collect()}
    assert got == {1: ("bsd", 1.0), 2: ("mit", 1.0), 3: ("bsd", 1.0), 4: ("", 0.0), 5: ("", 0.0), 6: ("", 0.0)}


def test_notices_match_brute_force(make_docs):
    """Every template whole, wrapped and with every eleventh or fifth word changed, at places around the windows' borders."""
    rows = []
    for k, (_, template) in enumerate(TEMPLATES):
        ws = template.split()
        rows.append((len(rows), "\n".join(ws)))
        for step in (11, 5):
            changed = " ".join(f"x{i}" if i % step == 2 else w for i, w in enumerate(ws))
            rows.append((len(rows), f"{'z ' * (17 * k)} {changed} {'q ' * (13 * k)}"))
        rows.append((len(rows), " ".join(ws[: len(ws) // 2] + ["z"] * (len(ws) // 3) + ws[len(ws) // 2 :])))
    got = {r["doc_id"]: (r["label"], r["score"]) for r in license_scan.notices(lowered(make_docs(rows))).groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("label"), F.max("score").alias("score")).collect()}
    assert {i: got.get(i, ("", 0.0)) for i, _ in rows} == {i: brute_notices(text) for i, text in rows}


def lowered(docs):
    return docs.select("doc_id", F.lit(0).alias("_key"), F.lower("text").alias("t"))


def test_rules_nest_and_the_longest_wins(spark):
    rules = [("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x/y", "allow"), ("b.a.org", "/x", "allow"),
             ("A.ORG", "/x", "allow"), ("a.org", None, "block")]
    urls = ["http://a.org/x1", "https://B.a.ORG/x/y?x", "s://c.b.a.org/x#", "http://ba.org/x", "http://org", "org/x",
            None, "", "http://a.org/x/y/z", "://a.org//x", "http://a..org/", "http://a.org:80/x"]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string, host string")
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, rules)).collect()}
    assert got == {
        (0, "a.org/x", "block"), (1, "b.a.org/x", "allow"), (2, "b.a.org/x", "allow"), (3, "org/", "allow"),
        (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"), (8, "a.org/x/y", "allow"),
        (9, "org/", "allow"), (10, "org/", "allow"), (11, None, "allow"),
    }
    assert url_filters.judge_urls(pages, url_filters.rule_table(spark, rules)).count() == 2 * len(urls)
    assert url_filters.judge_urls(pages.where("false"), url_filters.rule_table(spark)).count() == 0
    assert url_filters.judge_urls(pages, url_filters.rule_table(spark).where("false")).where("rule IS NOT NULL").count() == 0


def test_a_hot_host_gets_more_places(spark):
    urls = [(i, f"http://a.org/{i % 7}/{'p' * (i % 900)}") for i in range(400)] + [(i, f"http://h{i}.com/x") for i in range(400, 440)]
    pages = spark.createDataFrame([*urls, (500, None)], "page_id long, url string")
    rules = url_filters.rule_table(spark, [("org", "/3", "block"), ("a.org", "/5/p", "block"), ("com", "/", "block")])
    keys = pages.select(url_filters.host_key(url_filters.host_and_path(F.col("url"))[0]).alias("_key"))
    starts, widths = url_filters.places(keys, 8, 2, 10)
    assert max(widths) >= 40 and starts == [sum(widths[:g]) for g in range(8)]
    few = {tuple(r) for r in url_filters.judge_urls(pages, rules, groups=8, salts=1, rows=10**9).collect()}
    many = {tuple(r) for r in url_filters.judge_urls(pages, rules, groups=8, salts=2, rows=10).collect()}
    assert few == many and len(few) == 441
    assert {r[0] for r in few if r[-1] == "block"} == {
        i for i, u in urls if u.startswith(("http://a.org/3", "http://a.org/5/p")) or ".com" in u
    }


@pytest.mark.parametrize("text", ["", "a", "x\ny"])
def test_hash_of_cleaned_text(make_docs, text):
    row = line_dedup.clean_lines(make_docs([(1, text)])).select(F.sha2(F.encode("text", "UTF-8"), 256)).first()
    assert row[0] == hashlib.sha256(text.encode()).hexdigest()
