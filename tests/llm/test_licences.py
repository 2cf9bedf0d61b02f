import re

from wordloom.llm import licences as L

LINES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "MIT",
    "Licensed under the Wobbly Teapot License, Version 8.": "unknown",
    "She holds a pilot license and a warrant.": None,
    "nothing to see here": None,
}


def test_families_unknown_and_prose(spark):
    rows = [(i, f"some words before\n{t}\nand after", "x") for i, t in enumerate(LINES)] + [(100, None, "x"), (101, "", "x"), (0, f"some words before\n{list(LINES)[0]}\nand after", "x")]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect()
    found = {r.doc_id: r.family for r in got}
    assert {i: found.get(i) for i in range(len(LINES))} == dict(enumerate(LINES.values()))
    assert sum(r.doc_id == 0 for r in got) == 2 and all(r.paragraph == 1 and r.confirmed == (r.family != "unknown") for r in got)


# Written by hand, not by the rules that training notices come from.
HELD = [
    ("You can copy this under the terms of the MIT license", "MIT"),
    ("Dual use is fine: our code falls under Apache 2.0", "Apache-2.0"),
    ("Photos: CC BY-SA 4.0, unless noted", "CC-BY-SA"),
    ("Texts on this page may be shared under CC BY-ND 4.0", "CC-BY-ND"),
    ("We ship it under the BSD Zero Clause License", "0BSD"),
    ("The library is covered by GPL v2", "GPL-2.0"),
    ("Made available under the Mozilla Public License, Version 2.0 by its makers", "MPL-2.0"),
    ("This data set is in CC0 1.0 Universal", "CC0"),
    ("The firmware is provided under the GNU Lesser General Public License, version 3", "LGPL"),
    ("Sources: AGPL 3.0 or any later one", "AGPL-3.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BSD"),
    ("The MIT License does not apply", None),
    ("This chapter is not licensed under the Apache License 2.0", None),
    ("The museum renewed its alcohol license in May", None),
    ("Copyrighted.", "unknown"),
    ("Licensees must redistribute nothing", "unknown"),
    ("This software comes under the Pumpkin Patch License 12", "unknown"),
    ("Der Hund ging mit der Katze ins Haus", None),
]


# Notices of licences that are no family, and claims of rights; none may be lost. Written by hand, apart from training and from the bound's notices.
OTHER = [
    "This file is licensed under the zlib license.", "Boost Software License, version 1", "Licensed under the EUPL-1.2", "Microsoft Public License (MS-PL)", "Python Software Foundation License 2", "Copyrighted.", "Licensees must redistribute nothing", "Lizenz: GNU FDL 1.3", "Released under the Ruby License",
    "Code is under the Sleepycat License", "Licensed under LPPL 1.3c", "SPDX-License-Identifier: BlueOak-1.0.0", "License: ODbL-1.0", "Distributed under the NASA Open Source Agreement license", "The model weights have a community license", "Licencia: propia del autor", "Licence : CeCILL-B", "Lizenziert unter der Deutschen Freien Softwarelizenz",
    "Copyright 1998-2004 Lumen Labs", "Copyright Lumen Labs. All rights reserved worldwide.", "May be redistributed with written consent only", "Redistribution in any form is forbidden", "Licensed to the school for internal use", "Proprietary license, ask the vendor", "License: none of the usual ones", "This package uses the Perl license",
    "Licensed under the terms of the Quartz Agreement", "The maps are under the Open Government Licence", "Released under the Hippocratic License 2.1", "Licensed under the Parity Public License",
]
# Prose with a word of licences that names none; reporting it as unknown costs a reader's time, so it is counted.
PROSE = [
    "The museum renewed its alcohol license in May", "He forgot his driving license at home", "A teaching license takes two years", "The shop sells licensed toys", "My grandmother had a licence for her radio", "Copyright in letters belongs to the writer, the judge said", "The guard asked the trucker for a license", "No warranty covers a flooded cellar",
    "The senate debated copyright reform until midnight", "Sie hat den Führerschein, aber keine Lizenz zum Fliegen", "La policía pidió la licencia de conducir", "Un permis n'est pas une licence", "Their license to fish was revoked", "She holds a pilot license and a warrant.", "The gnu herd crossed the river", "A search warrant was signed at noon",
]


def test_held_out_notices_written_by_hand(spark):
    rows = [(i, t) for i, (t, _) in enumerate(HELD)]
    found = {r.doc_id: r.family for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [t for i, (t, want) in enumerate(HELD) if want and found.get(i) is None]
    assert not lost
    wrong = [(t, found.get(i), want) for i, (t, want) in enumerate(HELD) if want not in (None, "unknown") and found.get(i) != want]
    assert len(wrong) <= 2, wrong
    assert all(found.get(i) in (None, "unknown") for i, (t, w) in enumerate(HELD) if w in (None, "unknown")), found


def test_no_other_licence_is_lost(spark):
    rows = list(enumerate(OTHER + PROSE))
    found = {r.doc_id: r.family for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(t, found.get(i)) for i, t in rows[: len(OTHER)] if found.get(i) != "unknown"] == []
    assert all(found.get(i) in (None, "unknown") for i, _ in rows[len(OTHER) :])
    assert sum(i in found for i, _ in rows[len(OTHER) :]) <= 8


def test_no_cued_paragraph_is_lost(spark):
    """Every paragraph with a cue is scored, also one without a known n-gram, and the trained model loses none of them."""
    texts = ["Lizenz: zqx licenseeism", "copyrightish zzz", "licensure qqqq", "x" * 200000 + " licence"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert L.paragraphs(docs).count() == len(texts)
    got = L.scan(docs).collect()
    assert len(got) == len(texts) and all(r.family == "unknown" and not r.confirmed for r in got)


def test_wrapped_paragraphs_are_one(spark):
    text = """intro
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License.
end"""
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.paragraph, r.family) for r in got] == [(1, "GPL-3.0")]


def test_a_paragraph_without_cue_cannot_be_confirmed():
    import re as _re

    pattern = _re.compile(L.cue().replace("\\p{L}\\p{N}", "^\\W_").replace("[^^", "[").replace("[\\W_]+", "[\\W_]+"))
    inside = lambda c, g: any(g[i : i + len(c)] == c for i in range(len(g) - len(c) + 1))
    for _, t in L.template_texts():
        whole = L.text_grams(t)
        assert sum(not any(inside(c, g) for c in L.cover()) for g in whole) < L.MIN_SHARE * len(whole)
        assert pattern.search(t), t


def test_grams_equal_brute_force(spark):
    from pyspark.sql import functions as F

    text = "The Apache-2.0 License, the apache"
    w = re.findall(r"[^\W_]+(?:[.+][^\W_]+)*", text.lower())
    want = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    got = spark.createDataFrame([(text,), ("",), ("one",)], "t string").select(L.grams(F.col("t")).alias("g")).collect()
    assert set(got[0].g) == want and got[1].g == [] and got[2].g == ["one"]


def test_empty_table(spark):
    assert L.licence_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
