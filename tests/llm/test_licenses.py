import pytest

from stateroll.llm import licenses as op
from stateroll.llm.queries import QUERIES
from tests.llm import oracle

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
}


@pytest.fixture(scope="module")
def model(spark):
    return op.train(spark.read.parquet(f"{oracle.SF}/documents.parquet"))


def rows(spark, model, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, found string")
    return {r.doc_id: r for r in op.licences(df, model).collect()}


def test_families_and_unknown(spark, model):
    texts = [*LINES, "intro\nreleased under the Mozilla Public License 2.0\nand\nCC BY 4.0", "Copyright notice, all rights reserved.", "The driver's license was renewed in version 2.0.", None, "", "the thon of erble " * 20_000, "Licensed under the Apache License, Version 2.0." + " on er th" * 40]
    got = rows(spark, model, texts)
    assert [got[k].licences for k in range(4)] == list(LINES.values())
    assert got[4].licences == "cc-by-4.0,mpl-2.0" and got[4].n_confirmed == 2
    assert [got[k].licences for k in range(5, 10)] == [""] * 5
    assert got[10].licences == "apache-2.0"
    assert got[0].best > 0.5 and got[8].best == 0.0


def test_all_templates(spark, model):
    want = [(f, t) for f, t in op.templates()]
    got = rows(spark, model, [t for _, t in want])
    right = sum(got[k].licences == f for k, (f, _) in enumerate(want))
    assert right >= 0.97 * len(want)


def test_licences_of_no_family_and_repeated_and_long_texts(spark, model):
    strange = [t for t in op.STRANGERS]
    notice = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    texts = [*strange, notice, notice, "word " * 200_000 + "\n\n" + notice + "\n\n" + "word " * 200_000]
    got = rows(spark, model, texts)
    assert [got[k].licences for k in range(len(strange))] == [""] * len(strange)
    assert [got[len(strange) + k].licences for k in range(3)] == ["gpl-3.0"] * 3


def test_scores_by_hand(spark, model):
    import math
    import re

    text = "released under the mit license. this is other text"
    words = re.findall(op.TOKEN, text)
    total = list(model.bias)
    for g in {*words, *map(" ".join, zip(words, words[1:]))}:
        total = [a + b for a, b in zip(total, model.weights.get(g, [0.0] * len(total)))]
    want = 1 / (1 + math.exp(-(total[1 + model.families.index("mit")] - total[0]) * model.slope - model.shift))
    found = op.scan(spark.createDataFrame([(1, text)], "`doc.id` int, `the.text` string"), model, "doc.id", "the.text").first().found
    assert [f.family for f in found if f.similarity >= 0.8] == ["mit"]
    assert abs(next(f.confidence for f in found if f.family == "mit") - want) < 1e-9


def test_identifiers(spark, model):
    want = {
        "SPDX-License-Identifier: MIT": "mit", "# SPDX-License-Identifier: ISC": "isc", "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
        "/* SPDX-License-Identifier: GPL-3.0-or-later */": "gpl-3.0", "SPDX-License-Identifier: LGPL-3.0-only": "lgpl-3.0", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "int main() {}\n// SPDX-License-Identifier: MIT\nreturn 0;": "mit",
        "He studied at MIT and ISC in Boston.": "", "SPDX-License-Identifier: LicenseRef-Own": "", "mit den Worten": "", "the identifier: MIT": "",
    }
    got = rows(spark, model, list(want))
    assert [got[k].licences for k in range(len(want))] == list(want.values())


def test_screen_skips_only_what_cannot_count(spark, model):
    assert model.screen
    df = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    kept, model.screen = model.screen, ""
    whole = oracle.frame(op.licences(df, model))
    model.screen = kept
    assert oracle.frame(op.licences(df, model)) == whole


def test_empty_table_trains(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.licences(df, op.train(df)).count() == 0


def test_query(spark):
    got = QUERIES["op5_licenses"](spark, oracle.SF)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    texts = dict(oracle.rows("SELECT doc_id, text FROM documents"))
    found = {r.doc_id: r.licences for r in got.collect()}
    assert found == {k: ",".join(sorted({f for line in t.split("\n") for n, f in LINES.items() if n in line})) for k, t in texts.items()}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GNU = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU{} General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BSD = """3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
WRAPPED = "This file is offered to everybody under the Apache License,\nVersion 2.0, by its authors."


def test_notices_and_bodies(spark, model):
    filler = "\n".join(["the thon of erble heon tion ande"] * 300)
    texts = [MIT, GNU.format("", 3), GNU.format("", 2), GNU.format(" Lesser", 3), ISC, BSD, WRAPPED, f"{filler}\n{GNU.format('', 3)}\n{filler}\n{MIT}\n{filler}", f"{MIT}\n *\n{WRAPPED}\n\n{ISC}"]
    got = rows(spark, model, texts)
    assert [got[k].licences for k in range(9)] == ["mit", "gpl-3.0", "gpl-2.0", "lgpl-3.0", "isc", "bsd-3-clause", "apache-2.0", "gpl-3.0,mit", "apache-2.0,isc,mit"]
    assert got[8].n_confirmed == 3


def test_like_texts_of_other_licences(spark, model):
    texts = [GNU.format(" Affero", 3), GNU.format(" Lesser", "2.1"), MIT.replace("deal\nin", "deal\nwith"), MIT.split(", subject")[0] + ".", ISC.split(", provided")[0] + "."]
    got = rows(spark, model, texts)
    assert [got[k].licences for k in range(5)] == [""] * 5


def test_several_families_in_a_paragraph(spark, model):
    got = rows(spark, model, ["Licensed under the Apache License, Version 2.0 or released under the MIT License.", "Distributed under the terms of the GNU General Public License, version 2."])
    assert got[0].licences == "apache-2.0,mit" and got[0].n_confirmed == 2
    assert got[1].licences == "gpl-2.0"


def test_frequent_corpus_words_leave_the_templates_grams(spark, monkeypatch):
    monkeypatch.setattr(op, "MAX_GRAMS", 200)
    few = op.train(spark.read.parquet(f"{oracle.SF}/documents.parquet"))
    want = op.templates()
    got = rows(spark, few, [t for _, t in want])
    assert sum(got[k].licences == f for k, (f, _) in enumerate(want)) >= 0.97 * len(want)
