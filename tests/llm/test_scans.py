"""Secrets, benchmark items, quality and URLs against plain Python and planted cases."""

import random
import re

import pandas as pd
import pytest
import small

from panelift.llm import decontaminate, licenses, quality, secrets, urls

SECRET = re.compile(r'(?i)(?:token = "([0-9a-f]{40})"|password=([0-9a-f]{18})|(AKIA[0-9A-Z]{16}))')


def planted(rows):
    found = set()
    for i, text in rows:
        for m in SECRET.finditer(text or ""):
            group = next(k for k in (1, 2, 3) if m.group(k))
            found.add((i, m.start(group), m.group(group)))
    return found


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_all_planted_secrets_and_no_others(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = secrets.find(docs).collect()
    assert {(r.doc_id, r.start, r.token) for r in found} == planted(rows)
    assert all(0.5 <= r.score <= 1 and r.length == len(r.token) for r in found)


def test_masking_changes_secrets_only(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {(r.doc_id, r.start, r.token) for r in secrets.find(docs).collect()}
    assert found == planted(rows)
    want = []
    for i, text in rows:
        for _, start, token in sorted((x for x in found if x[0] == i), reverse=True):
            text = text[:start] + secrets.MASK + text[start + len(token) :]
        want.append((i, text))
    masked = secrets.mask(docs, secrets.find(docs))
    assert masked.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in masked.collect()), key=repr) == sorted(want, key=repr)


def test_forest_learns_from_given_findings(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    code = lambda n: "".join(rng.choice("abcdefXYZ0123456789") for _ in range(n))
    labelled = [(code(24), "key is ", " end", 1) for _ in range(60)] + [(word(24), "word is ", " end", 0) for _ in range(60)]
    labelled = spark.createDataFrame(labelled, "token string, before string, after string, label int")
    docs = spark.createDataFrame([(1, f"here {code(24)} and {word(24)}"), (2, None), (None, f"x {code(24)}")], "doc_id long, text string")
    found = secrets.find(docs, labelled=labelled).collect()
    assert sorted((r.doc_id or 0, r.start) for r in found) == [(0, 2), (1, 5)]


def test_short_and_signed_values_and_dotted_tokens(spark):
    web = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    cases = [
        ('password = "Tr0ub4dor&3" end', "Tr0ub4dor&3"), ("pwd: p@ss.w0rd!9\nend", "p@ss.w0rd!9"), (f"see {web} end", web),
        ("get https://admin:S3cret-pw99@host.example.org/x", "S3cret-pw99"), ("db://u:p@ss@host", "p@ss"), ("password: required words", None),
        ("plain text with international words", None), ("mail long.name.somewhere@example.org or http://host:8080/a", None),
    ]
    docs = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(cases)], "doc_id long, text string")
    found = secrets.find(docs)
    assert sorted((r.doc_id, r.start, r.token) for r in found.collect()) == [(n, t.index(x), x) for n, (t, x) in enumerate(cases) if x]
    masked = {r.doc_id: r.text for r in secrets.mask(docs, found).collect()}
    assert masked == {n: t.replace(x, secrets.MASK) if x else t for n, (t, x) in enumerate(cases)}


def distance(pattern, text):
    before, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for at, c in enumerate(text, 1):
        now = [0]
        for i, p in enumerate(pattern, 1):
            now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (p != c)))
        before = now
        best = min(best, (now[-1], at))
    return best


def test_bit_parallel_distance():
    rng = random.Random(0)
    for _ in range(400):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontaminate.best_match(pattern, text) == distance(pattern, text)


def test_items_within_budget_are_found(spark):
    rng = random.Random(4)
    items = [(n, small.prose(900 + n, 25)) for n in range(8)] + [(50, None), (51, "short"), (52, small.prose(900, 25)), (None, "")]
    rows = [(0, None), (1, ""), (2, small.prose(1, 3000))]
    for n in range(40):
        text = list(items[n % 8][1])
        for _ in range(rng.randint(0, 10)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        rows.append((10 + n, small.prose(2000 + n, rng.randint(0, 40)) + " " + "".join(text) + "\n" + small.prose(3000 + n, 9)))
    rows += [rows[-1], (None, rows[-2][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hits string")
    found = decontaminate.find_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    clean = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    want = []
    for i, text in rows:
        for key, item in items[:8]:
            item = clean(item)
            best, end = distance(item, clean(text))
            if best <= int(len(item) * decontaminate.ERROR_RATE):
                want.append((i, key, best, end))
    got = [(r.doc_id, h.item_id, h.distance, h.end) for r in found.collect() for h in r.hits]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(want) > 10


def test_short_items_are_found_as_whole_words(spark):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "x-ray"), (3, "?!"), (4, None), (5, "X ray")], "item_id long, text string")
    texts = ["Q: what is the  capital of France", "What is the capital of Frances", "x-rays; an X-ray.", "x ray", "what is the capitol of france", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, *h) for r in decontaminate.find_items(docs, items).collect() for h in r.hits]
    assert sorted(got) == [(0, 1, 0, 31), (2, 2, 0, 15), (3, 2, 0, 5)]
    assert sorted(r.item_id for r in decontaminate.wordless_items(items).collect()) == [3, 4]


def test_items_in_several_passes(spark, data, monkeypatch):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    once = decontaminate.find_items(docs, items).select("doc_id", "hits").collect()
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 2000)
    again = decontaminate.find_items(docs, items).select("doc_id", "hits").collect()
    flat = lambda rows: sorted((r.doc_id, tuple(h)) for r in rows for h in r.hits)
    assert flat(once) == flat(again) != []


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    from panelift.llm.queries import QUERIES

    scored = QUERIES["op8_quality_classifier"](spark, folder)
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() >= 0.97
    import zlib

    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(rows.doc_id, rows.held_out))


def test_quality_ignores_held_out_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    one = quality.fit_on_labels(spark, docs, labels)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert quality.fit_on_labels(spark, docs, flipped) == one


def test_quality_of_odd_texts(spark, awkward, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_on_labels(spark, docs, labels)
    rows = quality.score(spark.read.parquet(f"{awkward}/documents.parquet"), model).toPandas()
    assert rows.score.between(0, 1).all()
    assert rows[rows.doc_id.isin([10, 11])].score.nunique() == 1
    untrained = quality.fit(docs.limit(0).selectExpr("text", "1 as label"))
    assert set(quality.score(docs, untrained).toPandas().score) == {0.5}


PAGES = [
    (1, "https://WWW.Example.net/en/1", None), (2, "http://a.net", ""), (3, "http://a.net/", ""), (4, "https://x.example.com/de/3?q=/fr/", ""),
    (5, "http://y.org/fr/", ""), (6, "http://notexample.com/de/", ""), (7, None, "x"), (8, "no scheme.net/", ""), (None, "http://z.org/", ""),
    (9, "http://alias.org/a", '<link rel="canonical" href="https://bad.net/page">'),
    (10, "http://alias.org/b#x", "<meta http-equiv=refresh content='0; url=/a'>"),
    (11, "http://free.org/a", "<link href=//example.net/en/ok rel=canonical>"),
    (12, "http://free.org/b", '<link rel="canonical" href="http://free.org/a?utm_source=feed">'),
    (12, "http://free.org/b", '<link rel="canonical" href="http://free.org/a?utm_source=feed">'),
    (13, "http://mixed.org/1", '<link rel="canonical" href="http://mixed.org/2">'),
    (14, "http://mixed.org/2", '<link rel="canonical" href="http://host.net/x">'),
    (15, "http://mixed.org/3", '<meta http-equiv="refresh" content="5;url=http://mixed.org/2"><link rel=canonical href="http://q.org/fr/1">'),
    (16, "https://host.net/x", '<link rel="canonical" href="http://free.org/a">'), (17, "http://loop.org/", '<link rel=canonical href="http://loop.org/">'),
]


def test_verdicts(spark, tmp_path):
    from panelift.llm.queries import QUERIES

    rows = QUERIES["op10_url_filters"](spark, small.write(str(tmp_path), pages=PAGES)).collect()
    assert len(rows) == len(PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("a.net", "", None, "allow")
    assert got[3] == ("a.net", "/", "net/", "block")
    assert got[4] == ("x.example.com", "/de/3", "example.com/de/", "block")
    assert got[5] == ("y.org", "/fr/", "org/fr/", "allow")
    assert got[6] == ("notexample.com", "/de/", None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2:] == got[10][2:] == (None, "block")  # carried from bad.net, over a redirect as well
    assert got[16][2:] == ("net/", "block")  # its own rule stands
    assert {got[i][3] for i in (11, 12, 13, 14, 15)} == {"allow"}  # one allowed address frees its aliases
    assert got[17][3] == "allow"


def test_license_labels(spark):
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in small.documents()], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert rows[21].base_labels == "apache,cc-by,gpl,mit"
    assert rows[22].labels == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0"
    assert (rows[23].n_base, rows[23].first_word, rows[23].last_word) == (2, 3, 11)
    assert rows[10].n_words == 0 and rows[10].first_word is None and rows[10].labels == ""


WRAPPED = [
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"),
    ("mpl-2.0", " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed"),
    ("mit", "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\")"),
    ("apache-2.0", "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("cc-by-4.0", "dnl This work is licensed under a Creative\ndnl Commons Attribution 4.0\ndnl International License."),
]


def test_wrapped_notices(spark):
    rows = [(n, f"some text\n{notice}\nmore text") for n, (_, notice) in enumerate(WRAPPED)]
    apart = "Redistribution and use in source and binary forms " + "word " * 40 + "with or without modification are permitted provided that the following conditions are met"
    rows += [(90, apart.replace("word with", "word\nwith")), (91, None)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [n for n, (label, _) in enumerate(WRAPPED) if label not in found[n].labels.split(",") or found[n].score < licenses.CONTAINMENT] == []
    assert (found[90].labels, found[90].score, found[91].labels) == ("", 0.0, "")


def test_template_filters_lose_nothing(spark):
    rng = random.Random(5)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split(" ")})
    lines = []
    for _ in range(600):
        base = rng.choice(licenses.TEMPLATES)[1].split(" ")
        lines.append(" ".join(w for w in base if rng.random() < 0.97) + " " + " ".join(rng.sample(words, 3)))
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(60), "text": ["\n".join(lines[i::60]) for i in range(60)]}))
    got = {(r.doc_id, r.block, r.label, round(r.containment, 9)) for r in licenses.template_blocks(docs, ["doc_id"]).collect()}
    want = set()
    for i in range(60):
        for block, line in enumerate(lines[i::60]):
            for label, template in licenses.TEMPLATES:
                need = set(template.split(" "))
                share = len(need & set(line.split(" "))) / len(need)
                if share >= licenses.CONTAINMENT:
                    want.add((i, block, label, round(share, 9)))
    assert got == want and len(want) > 100


def test_every_link_of_a_page_counts(spark):
    from panelift.llm import urls

    html = '<link rel="canonical" href="http://a.org/1"><link rel=canonical href="/2"><meta http-equiv="refresh" content="0;url=http://b.org/3">'
    pages = spark.createDataFrame([(1, "http://x.org/p", html), (2, "http://y.org/q", None)], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in urls.page_links(pages).collect())
    assert got == [("http://x.org/p", "http://a.org/1"), ("http://x.org/p", "http://b.org/3"), ("http://x.org/p", "http://x.org/2")]
