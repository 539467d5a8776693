import base64
import hashlib
import os
import textwrap

import duckdb
import pytest

from parvis.llm import licences, queries, warc
from parvis.llm.common import shared_path

DATA = "/root/testdata/sf0.001"


def test_licence_rules(spark):
    grant, notice = licences.SENTENCES["mit-grant"][0], licences.SENTENCES["mit-notice"][0]
    gpl, later = licences.SENTENCES["gpl-share"][0], licences.SENTENCES["gpl-later"][0]
    texts = [
        None, "", "No licence here.", "Some text.\nReleased under the MIT License.\nMore.", f"{grant.upper()}. {notice}!",
        f"{notice}. {grant}.", f"{gpl}; {later}.", "Licensed under the  Apache License,\tVersion 2.0. And (licensed under CC BY-NC 4.0).",
        "All rights reserved.\nAll rights reserved.", "the MIT License",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, licences string")
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan(docs).collect()}
    assert got[0] == got[1] == got[2] == got[9] == ([], [])
    assert got[3] == got[10] == (["mit"], ["MIT"])
    assert got[4] == (["mit-grant", "mit-notice"], ["MIT"]) and got[5] == (["mit-notice", "mit-grant"], [])
    assert got[6] == (["gpl-share", "gpl-later"], ["GPL-3.0-or-later"])
    assert got[7] == (["apache-2.0"], ["Apache-2.0"]) or got[7] == (["apache-2.0", "cc-by-nc-4.0"], ["Apache-2.0", "CC-BY-NC-4.0"])
    assert got[8] == (["reserved", "reserved"], ["proprietary"])
    assert licences.scan(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        licences.scan(docs, sentences={"many": [str(i) for i in range(licences.MAX_SENTENCES + 1)]})


def test_licence_oracle(spark, tmp_path):
    folder = DATA
    if not os.path.isdir(folder):
        pytest.skip("test tables not present")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(licences.oracle())
    names = [c[0] for c in want.description]
    df = queries.op2_licences(spark, folder)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want.fetchall())
    assert df.where("n_sentences > 0").count() > 0


def pages(spark):
    rows = [
        (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://a\n/4", None), (5, "u", ""),
        (6, "u", "é😀" * 5000 + "\r\n\r\nWARC/1.1\r\n"), (7, "u", "x\r\n\r\ny"), (None, "u", "<p>one</p>"), (8, "u", "z" * 4096), (9, "u", "z" * 4097),
        (None, None, "only"), (7, "u", "x\r\n\r\ny"),
    ]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, chunk int")


@pytest.mark.parametrize("chunk", [7, 4096, 1 << 16])
def test_archives(spark, chunk):
    df = pages(spark)
    path = shared_path(spark, "warc-test")
    rows = warc.archived(df, path, chunk=chunk).collect()
    source = df.collect()
    assert len(rows) == len(source)
    largest = {}
    for p in source:
        if p.page_id is not None:
            largest[p.html or ""] = max(p.page_id, largest.get(p.html or "", -1))
    want = []
    for p in source:
        body = p.html or ""
        raw = body.encode()
        last = largest.get(body)
        again = last is not None and sum((q.html or "") == body for q in source) > 1 and p.page_id != last
        want.append((str(p.page_id) if p.page_id is not None else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                     "revisit" if again else "response", str(last) if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    table = warc.read_archives(spark, path)
    assert table.selectExpr("max(length(payload))").first()[0] <= chunk
    whole = b"".join(bytes(r.payload) for r in table.where("page_id = 6").orderBy("chunk").collect())
    assert whole.decode() == source[5].html


def test_least_size(spark):
    rows = warc.archived(pages(spark), shared_path(spark, "warc-test"), least=100).collect()
    assert all(r.record_type == "response" for r in rows)


def test_no_pages(spark):
    assert warc.archived(pages(spark).limit(0), shared_path(spark, "warc-test")).collect() == []


def test_wrapped_notices(spark):
    """Hard-wrapped notices, also in comments, and licences outside the first list."""
    wrap = lambda s, before="": "\n".join(before + x for x in textwrap.wrap(s, 72))
    say = lambda name, k=0: licences.SENTENCES[name][k].capitalize()
    mit = f"{wrap(say('mit-grant'))}:\n\n{wrap(say('mit-notice'))}."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance\nwith the License.\nYou may obtain a copy'
    texts = {
        mit: "MIT", "The MIT License\nCopyright (c) 2020 A B\n" + mit: "MIT", "".join(f"# {x}\n" for x in apache.split("\n")): "Apache-2.0",
        "/*\n" + "".join(f" * {x}\r\n" for x in apache.split("\n")) + " */": "Apache-2.0",
        f"{wrap(say('bsd-redistribute'), '// ')}:\n// 1. Some\n//\n// 3. {wrap(say('bsd-no-endorse'), '// ')[3:]}.": "BSD-3-Clause",
        "a line without an end\nReleased under the MIT License\nanother line": "MIT", wrap(say("gpl-share-3-later")) + ".": "GPL-3.0-or-later", wrap(say("gpl-share-2-later"), "-- ") + ".": "GPL-2.0-or-later",
        wrap(say("lgpl-2.1-later")) + ".": "LGPL-2.1-or-later", wrap(say("agpl-3.0-later")) + ".": "AGPL-3.0-or-later", wrap(say("isc")) + ".": "ISC",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy": "MPL-2.0", wrap(say("unlicense")) + ".": "Unlicense", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "Released under the\n\nMIT License.": "", "not released under the\nMIT License.": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ",".join(r.licences) for r in licences.scan(docs).collect()}
    assert got == dict(enumerate(texts.values()))


def test_sentences_of_the_caller(spark):
    """Words of the caller's own sentences pass the cheap test as well."""
    docs = spark.createDataFrame([(1, "Do What You\nWant To."), (2, "do what you can"), (3, "All rights reserved.")], "doc_id long, text string")
    rules = (licences.Rule("WTF", ("wtf",)),)
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan(docs, sentences={"wtf": ["do what you want to"]}, rules=rules).collect()}
    assert got == {1: (["wtf"], ["WTF"]), 2: ([], []), 3: ([], [])}


def test_every_known_sentence_is_found_alone(spark, tmp_path):
    """In Spark and in SQL, whose cheap test has the same words."""
    known = [(i, s) for i, group in licences.SENTENCES.items() for s in group]
    docs = spark.createDataFrame([(k, f"{s.capitalize()}.") for k, (_, s) in enumerate(known)], "doc_id long, text string")
    got = {r.doc_id: r.sentence_ids for r in licences.scan(docs).collect()}
    assert got == {k: [i] for k, (i, _) in enumerate(known)}
    docs.write.parquet(str(tmp_path / "documents"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
        assert dict(db.execute(f"SELECT doc_id, sentence_ids FROM ({licences.oracle()})").fetchall()) == {k: i for k, (i, _) in enumerate(known)}
