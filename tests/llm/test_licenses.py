from tidemark.llm import licenses as lic


def test_whole_texts_and_notices(spark):
    mit = lic.TEXTS["MIT"]
    rows = [
        (1, mit), (2, mit.upper().replace("<YEAR> <HOLDER>", "2021 Jane Doe")), (3, mit.replace("MIT License", "MIT Licence").replace(" ", "  ")), (4, mit + " and more"),
        (5, None), (6, ""), (7, "text\nLicensed under CC BY-NC 4.0.\nmore\nreleased under the mit licence"), (8, "All Rights Reserved"), (9, lic.TEXTS["ISC"]),
    ]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k][0] for k in range(1, 10)] == ["MIT", "MIT", "MIT", None, None, None, None, None, "ISC"]
    assert got[7][1] == "CC-BY-NC-4.0,MIT" and got[8][1] == "Proprietary" and got[5][1] == ""


def test_rows_and_empty(docs, empty, corpus):
    assert lic.scan(docs).count() == len(corpus)
    assert lic.scan(empty).count() == 0


def test_wrapped_and_untitled_texts(spark):
    import textwrap

    rows = []
    for k, (name, text) in enumerate(sorted(lic.TEXTS.items())):
        body = text.split("\n\n", 1)[1] if "License\n" in text else text
        for width in (40, 47, 72, 79):
            lines = "\n\n".join(textwrap.fill(part, width) for part in body.replace("<year> <holder>", "1999-2004 The Holders").split("\n\n"))
            rows.append((name, lines))
        rows.append((name, "The " + text if "License\n" in text else text))
    got = lic.scan(spark.createDataFrame(rows, "name string, text string"), keep=("name",)).collect()
    assert all(r["license_id"] == r["name"] for r in got), [r["name"] for r in got if r["license_id"] != r["name"]]


def test_rights_of_a_copyright_line_and_given_tables(spark):
    rows = [(1, "Copyright 2020 X. All rights reserved."), (2, 'Licensed under the Apache License, Version 2.0 (the "License");'), (3, "SPDX-License-Identifier: MPL-2.0"), (4, "Copyright holders be liable"), (5, "my own terms\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = lic.known(spark, [("Own", "My own TERMS.")])
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in lic.scan(df, table=table, rows=1).collect()}
    assert got == {1: (None, "Proprietary"), 2: (None, "Apache-2.0"), 3: (None, "MPL-2.0"), 4: (None, ""), 5: ("Own", "")}


def test_sql_gives_the_same_rows(spark, corpus):
    duckdb = __import__("duckdb")
    rows = [(i, t) for i, t, _ in corpus if i is not None and i < 208] + [(1000 + k, t) for k, t in enumerate(lic.TEXTS.values())] + [(2000 + k, t) for k, (_, t) in enumerate(lic.NOTICES)] + [(3000, "(c) 2020 Me, all rights reserved\nMIT License\n")]
    rows = list(dict(rows).items())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", "text_digest", "license_id", "notices"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({lic.OP9_SQL})").fetchall(), key=str)
    got = sorted((tuple(r[n] for n in names) for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == want
