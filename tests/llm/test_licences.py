from cohortgrid.llm import licences

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = " ".join(licences.SENTENCES[x] + "\n" for x in ("BsdUse", "BsdSource", "BsdBinary"))


def found(make, rows):
    return {r["doc_id"]: r["licenses"] for r in licences.scan(make(list(enumerate(rows)))).collect()}


def test_rules(make):
    rows = [
        "Some words. Licensed under the Apache License, Version 2.0. More words.",
        "words\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.",
        MIT,
        BSD + licences.SENTENCES["BsdNames"],
        BSD,
        licences.SENTENCES["BsdUse"] + "\nno conditions",
        "the apache license is mentioned here, version 2.0",
        "# SPDX-License-Identifier: MIT\nx = 1",
        "LICENSED UNDER THE APACHE LICENSE -- VERSION 2.0",
        "Released under the MIT License. " * 3000,
    ]
    assert found(make, rows) == {0: "Apache-2.0", 1: "CC-BY-NC-4.0,MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-2-Clause", 5: "NOASSERTION", 6: "", 7: "MIT", 8: "Apache-2.0", 9: "MIT"}


def test_every_rule_is_found_and_takes_its_sentences(make):
    texts = [" \n".join(licences.SENTENCES[x] for x in names) for _, names in licences.RULES]
    assert found(make, texts) == {i: lic for i, (lic, _) in enumerate(licences.RULES)}


def test_edges(make, spark):
    rows = [(1, None), (1, None), (2, ""), (None, "Released under the MIT License."), (3, "\n\n.;! ")]
    got = sorted(((r["doc_id"], r["n_known"], r["licenses"]) for r in licences.scan(make(rows)).collect()), key=str)
    assert got == sorted([(1, 0, ""), (1, 0, ""), (2, 0, ""), (3, 0, ""), (None, 1, "MIT")], key=str)
    assert licences.scan(make([])).count() == 0
    odd = spark.createDataFrame([(1, "x", 1)], "doc_id long, text string, line int")
    assert licences.scan(odd).count() == 1


def test_no_python_and_no_shuffle(make):
    plan = licences.scan(make([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
