"""Licence scan: a trained paragraph classifier over word n-grams, in DataFrame expressions only.

A paragraph is a line with the lines that it is wrapped over: a line end inside a sentence (a small
letter follows, or a line of wrapping width that no sentence ends) is read as a space. Paragraphs are
classified by multinomial logistic regression over the presence of word 1- to 3-grams. It is trained
here on notices that a rule builds from the families' names and usual sentences, on invented licences
(class `unknown`), and on prose that only mentions such words or says that a licence does not hold (class
`none`). A temperature, fitted on sentences and names that training leaves out, calibrates the
probabilities; a prediction below `MIN_P` becomes `unknown`. A family is confirmed if the paragraph
holds at least `MIN_SHARE` of the n-grams of one of the family's templates; a family that no template
confirms becomes `unknown` too. Class none needs more than the most likely class: its probability has to be
above a bound, the highest one that the model gives to any notice of other licences which training has
not seen (`UNSEEN`, written by hand, not by the rule of the training notices); below it a paragraph is `unknown`.

Only paragraphs with a cue are scored. Cues are general words (licence, copyright, ...) and, by a cover
computed from the templates, words and word pairs without which no paragraph can hold `MIN_SHARE` of
any template's n-grams; so a paragraph without a cue could never be confirmed, and is of class none by definition,
as is one that has none of the general words and that no template confirms.

Defined results: null and empty texts have no paragraphs; a cued paragraph without any known n-gram is
scored by the classes' offsets alone; repeated rows are reported as often as they occur; ties between
classes go to the alphabetically first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored

MIN_P, MIN_SHARE = 0.5, 0.6
#: n-grams that the model knows at most; they and their weights are broadcast.
MAX_GRAMS = 20_000
TOKEN = r"[\p{L}\p{N}]+(?:[.+][\p{L}\p{N}]+)*"
TOKENS = re.compile(r"[^\W_]+(?:[.+][^\W_]+)*")
#: A line end inside a sentence: after a line of wrapping width that no sentence ends, or before a small letter.
WRAP = r"\r?\n(?<=(?:^|\n)[^\n]{59,100}[^\n.!?:;]\n)(?=[\p{L}\p{N}(])|\r?\n(?<=[\p{L},][\r\n]{1,2})(?=\p{Ll})"
GENERAL = r"li[cz]en[scz]|copyright|copyleft|spdx|public domain|creative commons|\bcc[ -]?(?:by|0)\b|all rights reserved|redistribut|warrant|\bgnu\b|\bgpl|permission is hereby"

# The names under which licences are known.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL 3.0", "AGPL-3.0-or-later", "Affero GPL v3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache Software License 2.0", "Apache License 2.0"],
    "0BSD": ["BSD Zero Clause License", "0BSD", "Zero-Clause BSD", "BSD 0-Clause License"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0"],
    "CC-BY-NC": ["Creative Commons Attribution NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-NC 3.0"],
    "CC-BY-ND": ["Creative Commons Attribution NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND-4.0", "CC BY-ND 3.0"],
    "CC-BY-SA": ["Creative Commons Attribution ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "CC0": ["CC0 1.0 Universal", "CC0-1.0", "CC0 Public Domain Dedication", "Creative Commons Zero"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL v2", "GPL-2.0-only", "GNU GPL 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3", "GPL-3.0-or-later", "GNU GPL 3.0", "GNU General Public License version 3"],
    "ISC": ["ISC License", "ISC"],
    "LGPL": ["GNU Lesser General Public License, version 3", "LGPL v2.1", "LGPL-3.0", "GNU LGPL 2.1"],
    "MIT": ["MIT License", "MIT", "Expat License", "MIT license terms"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "unknown": ["Zorbel Community License 1.1", "In-House Source Terms", "Quill Free Document Agreement 3.0", "Harbour Open Data Charter, version 5", "Northwind Evaluation License", "Custom Reader License", "Example Vendor EULA", "Free Harvest License 0.9", "Public Garden License, Version 7"],
}
# Sentences in which notices name a licence.
OPENERS = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "This project is available under the {}.", "SPDX-License-Identifier: {}", "License: {}", "The code in this repository is covered by the {}; see LICENSE for details.", "You may use this file under the {} license.", "Copyright (c) 2020 the authors. Released under {}."]
# Names of licences that are no family here (class unknown).
OTHERS = ["zlib license", "Artistic License 2.0", "Eclipse Public License 2.0", "EPL-2.0", "Academic Free License v3.0", "Open Data Commons Attribution License", "SIL Open Font License 1.1", "OFL-1.1", "CeCILL v2.1", "GNU Free Documentation License 1.3", "GNU FDL", "Common Development and Distribution License", "CDDL-1.1", "PHP License 3.01", "PostgreSQL License", "NCSA Open Source License", "Business Source License 1.1", "Server Side Public License v1", "Elastic License 2.0", "Vim License"]
# Notices in the other languages of documents.
ABROAD = ["Lizenziert unter {}.", "Lizenz: {}", "Veröffentlicht unter der {}.", "Licencia: {}", "Publicado bajo la licencia {}.", "Licence : {}", "Publié sous licence {}.", "Licencja: {}"]
# Notices of other licences and of rights kept, written by hand. Training doesn't see them; the bound of class none comes from them.
UNSEEN = [
    "Boost Software License 1.0", "You may share this under the WTFPL", "The tables are under the Open Database License", "Licensed under EUPL v1.2 or later", "Microsoft Reciprocal License applies", "Python Software Foundation License Version 2", "Copyrighted material", "Copyright by the editors", "(c) 2011 Some Press, all rights reserved",
    "Licensees may not redistribute", "No licence is granted", "Redistribution only with consent", "Lizenz: Datenlizenz Deutschland 2.0", "Licencia de uso propia, versión 2", "Licence Ouverte 2.0", "The fonts come with their own license, see FONTS", "License terms: see the vendor's site", "Subject to the Acme Sample Code License",
    "Proprietary license. Do not copy.", "Governed by the Open Government Licence v3.0", "Die Software steht unter einer freien Lizenz", "Mit Lizenz der Stadt Bonn gedruckt", "Con licencia de la editorial", "Sous licence libre",
]
# Sentences that say a licence does not hold (class none).
NEGATED = ["The {} does not apply.", "The {} does not apply to this file.", "This file is not licensed under the {}.", "It is no longer available under the {}.", "Not released under the {}."]
# Short forms in which a name of one word stands as a template.
SHORT = ["{} License", "License: {}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "SPDX-License-Identifier: {}"]
# Words too usual to be cues by themselves.
USUAL = frozenset(
    "a an the of to in on and or is are be it its by for with without under at as this that you may not use used any all from if either either/or has have only permitted provided following conditions above "
    "list new free public general version part parts terms work file files form forms source binary code software person persons notice documentation associated obtaining charge purpose fee subject extent "
    "possible law author related rights domain international published foundation simplified into mit isc copy obtain except must kind express implied released was met binary distribute distributed modify reproduce compliance http".split()
)
# Words of which no pair is a cue.
SMALL = frozenset("a an the of to in on and or is are be it its by for with without under at as this that into from not".split())
# Usual sentences of the families' own texts.
SENTENCES = {
    "Apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "GPL-2.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "unknown": ["All rights reserved. No part of this publication may be reproduced without written permission of the publisher", "Copyright 2019 Example Press. All rights reserved.", "Use of this material is subject to the license agreement you signed", "Redistribution of this archive is not permitted", "Licensees agree to these terms", "The licensee may not copy the program", "No license is given to the reader", "Copyright held by the firm", "Copyright by the author", "Copyrighted work", "Proprietary and confidential", "Proprietary software. Do not distribute.", "Governed by the licence below", "See the license file for terms", "The images have their own license", "The files have a separate license", "This data has a custom license", "The code has a permissive license"],
    "none": ["The bar lost its license after the fire", "Her fishing licence was valid until spring", "Drivers without a licence pay a fine", "The court ruled that copyright ends seventy years after death", "A warrant was issued on Monday", "He asked for a copy of his marriage license", "The museum licenses pictures to newspapers", "Poetic license is allowed in songs", "They voted on a new copyright bill", "The machine is still under warranty", "Die Kneipe verlor nach dem Brand ihre Lizenz", "Der Pilot hat eine Lizenz zum Segelfliegen", "Der Trainer braucht eine Lizenz vom Verband", "El bar perdió su licencia", "El taxista mostró la licencia de taxi a la policía", "La licencia de obras tardó un año", "Il a perdu sa licence de pêche", "Elle a une licence de lettres", "Le club paie la licence de ses joueurs", "The license of the tavern was revoked", "Songs fall out of copyright in time", "He renewed his driving licence at the town hall", "The committee discussed copyright law and its history", "The warranty covers parts and labour for two years", "She asked whether the restaurant had a license to serve wine", "A fishing license costs nine dollars a season", "The lecture explains why copyright terms grew longer", "Licensing talks between the two studios failed", "He works at MIT and lives near the river", "The Apache river valley is dry in the summer", "The gnu is an antelope of the southern plains", "There is no warrant for such a claim", "The library moved its public domain books to the second floor", "The ministry plans to redistribute land among farmers", "Police had a search warrant for the flat"],
}
# Words from which prose is built that only mentions licences.
WHO = ["She", "He", "My neighbour", "The driver", "A student", "The company"]
DID = ["holds a pilot license", "lost the driving licence", "applied for a hunting license", "read about copyright", "signed a warranty for the car", "talked about a search warrant", "asked the city for a trade license", "renewed the liquor license", "keeps a fishing licence", "sued over a copyright", "got a marriage license", "lost the taxi licence", "studied copyright at college", "paid for a dog licence", "makes licensed football shirts", "had the licence revoked", "writes on copyright reform"]


def notices() -> list[tuple[str, str, bool]]:
    """(family, paragraph, held out for the temperature) of all training notices, by rule from the fixed values."""
    named = [(family, opener.format(name), (k + j) % 4 == 3) for family, names in NAMES.items() for k, name in enumerate(names) for j, opener in enumerate(OPENERS)]
    denied = [("none", x.format(name), (k + j) % 4 == 3) for family, names in NAMES.items() if family != "unknown" for k, name in enumerate(names) for j, x in enumerate(NEGATED)]
    prose = [("none", f"{who} {did}{end}", (i + j) % 4 == 3) for i, who in enumerate(WHO) for j, did in enumerate(DID) for end in (" last year.", " and a permit.")]
    other = [("unknown", x.format(name), False) for k, name in enumerate(OTHERS) for j, x in enumerate(OPENERS + ABROAD) if (k + j) % 3 == 0]
    abroad = [(family, x.format(name), False) for family, names in NAMES.items() if family != "unknown" for k, name in enumerate(names) for j, x in enumerate(ABROAD) if (k + j) % 4 == 0]
    return named + denied + prose + other + abroad + [(family, s, False) for family, several in SENTENCES.items() for s in several for _ in range(4)]


def template_texts() -> list[tuple[str, str]]:
    """(family, text) of the templates that confirm a family: its names, those of one word in their short forms, and its usual sentences."""
    names = [(f, x) for f, several in NAMES.items() if f != "unknown" for n in several for x in ([n] if len(TOKENS.findall(n)) > 1 else [s.format(n) for s in SHORT])]
    return names + [(f, s) for f, several in SENTENCES.items() if f not in ("unknown", "none") for s in several]


def text_grams(text: str) -> set[tuple[str, ...]]:
    w = TOKENS.findall(text.lower())
    return {tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


@cache
def cover() -> list[tuple[str, ...]]:
    """Words and word pairs such that the n-grams of each template without any of them are less than MIN_SHARE of it.

    Greedy: the candidate that takes the most n-grams from templates not yet covered; unusual words of four letters before
    pairs with an unusual word, these before other pairs, and short unusual words last.
    """
    unusual = lambda w: w not in USUAL and w not in SMALL and re.search("[a-z]", w)

    def tier(c: tuple[str, ...]) -> int:
        if len(c) == 1:
            return 4 if not unusual(c[0]) else 0 if len(re.findall("[a-z]", c[0])) >= 4 or re.search("[0-9][a-z]{3}", c[0]) else 3
        return 1 if any(unusual(w) for w in c) else 4 if SMALL.issuperset(c) else 2

    open_ = [(text_grams(t), text_grams(t)) for _, t in template_texts()]
    chosen: list[tuple[str, ...]] = []
    inside = lambda c, g: any(g[i : i + len(c)] == c for i in range(len(g) - len(c) + 1))
    while open_ := [(left, whole) for left, whole in open_ if len(left) >= MIN_SHARE * len(whole)]:
        gain: dict[tuple[str, ...], int] = {}
        for left, _ in open_:
            for c in {g for g in left if len(g) < 3 and tier(g) < 4}:
                gain[c] = gain.get(c, 0) + sum(inside(c, g) for g in left)
        best = min(gain, key=lambda c: (tier(c), -gain[c], c))
        chosen.append(best)
        open_ = [({g for g in left if not inside(best, g)}, whole) for left, whole in open_]
    return sorted(chosen)


def cue() -> str:
    """The pattern of a paragraph that is scored."""
    quoted = ["[^\\p{L}\\p{N}]+".join(re.escape(w) for w in c) for c in cover()]
    return rf"(?i){GENERAL}|(?<![\p{{L}}\p{{N}}])(?:{'|'.join(quoted)})(?![\p{{L}}\p{{N}}])"


def grams(text: Column) -> Column:
    """The distinct word 1- to 3-grams of a paragraph."""
    w = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)

    def of(t: Column, n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(w), lambda t: F.array_distinct(F.concat(of(t, 1), of(t, 2), of(t, 3)))), 1)


def train(spark: SparkSession) -> tuple[list[str], DataFrame, list[float], float]:
    """Classes, weights (gram, w: a weight for each class, over the temperature), the classes' offsets, and the bound of class none."""
    rows = [(i, family, text, held) for i, (family, text, held) in enumerate(notices())]
    data = spark.createDataFrame(rows, "i long, family string, text string, held boolean").withColumn("grams", grams(F.col("text")))
    classes = sorted({f for _, f, _, _ in rows})
    label = reduce(lambda c, k: c.when(F.col("family") == classes[k], float(k)), range(1, len(classes)), F.when(F.col("family") == classes[0], 0.0))
    data = data.withColumn("label", label).coalesce(1).cache()
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=MAX_GRAMS, minDF=2.0).fit(data)
    learner = LogisticRegression(maxIter=40, regParam=0.003, family="multinomial", standardization=False)
    part = learner.fit(vectorizer.transform(data.where("NOT held")))
    held = vectorizer.transform(data.where("held"))
    from pyspark.ml.functions import vector_to_array

    logits = part.transform(held).select("label", vector_to_array("rawPrediction").alias("z")).cache()
    temperatures = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8]
    loss = lambda t: F.avg(F.log(F.aggregate(F.transform("z", lambda x: F.exp((x - F.array_max("z")) / t)), F.lit(0.0), lambda s, x: s + x)) - (F.element_at("z", (F.col("label") + 1).cast("int")) - F.array_max("z")) / t)
    losses = logits.agg(*[loss(t).alias(str(k)) for k, t in enumerate(temperatures)]).first()
    t = temperatures[min(range(len(temperatures)), key=lambda k: losses[k])]
    model = learner.fit(vectorizer.transform(data))
    matrix, offsets = model.coefficientMatrix.toArray() / t, (model.interceptVector.toArray() / t).tolist()
    weights = spark.createDataFrame([(g, matrix[:, k].tolist()) for k, g in enumerate(vectorizer.vocabulary)], "gram string, w array<double>")
    data.unpersist()
    logits.unpersist()
    unseen = spark.createDataFrame(list(enumerate(UNSEEN)), "key long, line string")
    bound = classified(unseen, (classes, weights, offsets, 0.0)).agg(F.max("none")).first()[0]
    return classes, weights, offsets, bound


def templates(spark: SparkSession) -> DataFrame:
    """template, of (its family), size and gram of all templates."""
    t = spark.createDataFrame([(i, f, x) for i, (f, x) in enumerate(template_texts())], "template int, of string, text string").withColumn("grams", grams(F.col("text")))
    return t.select("template", "of", F.size("grams").alias("size"), F.explode("grams").alias("gram"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, paragraph (its number in the text), line: the paragraphs with a cue; rows that repeat a document share their keys."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text_col, WRAP, " "), "\n"), lambda x, i: F.struct(i.alias("paragraph"), x.alias("line"))), lambda s: s["line"].rlike(cue()))
    cued = docs.where(F.col(text_col).rlike(cue())).select(F.col(id_col).alias("doc_id"), F.explode_outer(lines).alias("p")).where("p IS NOT NULL")
    return cued.select(F.xxhash64("doc_id", "p.paragraph", "p.line").alias("key"), "doc_id", "p.paragraph", "p.line")


def classified(found: DataFrame, model: tuple[list[str], DataFrame, list[float], float]) -> DataFrame:
    """key, class, p, none (the probability of class none) of each paragraph (key, line). Only numbers are shuffled; a key of several rows counts once."""
    classes, weights, offsets, bound = model
    flat = found.select("key", F.posexplode_outer(grams(F.col("line"))).alias("k", "gram")).join(F.broadcast(weights), "gram", "left")  # at most MAX_GRAMS rows
    rows = F.sum((F.coalesce("k", F.lit(0)) == 0).cast("int"))
    sums = [(F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)) / rows + F.lit(offsets[k])).alias(f"z{k}") for k in range(len(classes))]
    scored = flat.groupBy("key").agg(*sums).select("key", F.array(*[F.col(f"z{k}") for k in range(len(classes))]).alias("z"))
    p = 1 / F.aggregate(F.transform("z", lambda x: F.exp(x - F.array_max("z"))), F.lit(0.0), lambda s, x: s + x)
    best = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("z", F.array_max("z")).cast("int"))
    scored = scored.select("key", best.alias("class"), p.alias("p"), (F.exp(F.col("z")[classes.index("none")] - F.array_max("z")) * p).alias("none"))
    doubtful = (F.col("class") == "none") & (F.col("none") <= bound)
    return scored.select("key", F.when(doubtful, "unknown").otherwise(F.col("class")).alias("class"), F.when(doubtful, 1 - F.col("none")).otherwise(F.col("p")).alias("p"), "none")


def compared(found: DataFrame) -> DataFrame:
    """key, share: of the best template of the paragraph's class; found has key, class, line."""
    spark = found.sparkSession
    flat = found.dropDuplicates(["key"]).select("key", "class", F.explode_outer(grams(F.col("line"))).alias("gram")).join(F.broadcast(templates(spark)), "gram").where(F.col("of") == F.col("class"))
    return flat.groupBy("key", "template").agg((F.count("*") / F.max("size")).alias("share")).groupBy("key").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[list[str], DataFrame, list[float], float] | None = None) -> DataFrame:
    """doc_id, paragraph, text, family, p, share (of the best template of the family), confirmed; a row for each licence-like paragraph.

    model: what `train` returned; trained anew where not given.
    """
    found = stored(paragraphs(docs, id_col, text_col))  # texts are searched once
    scored = cut(classified(found, model or train(docs.sparkSession)).where("class <> 'none'").drop("none"))
    held = found.join(scored, "key")
    share = F.coalesce("share", F.lit(0.0))
    out = held.join(compared(held), "key", "left").withColumn("share", share)
    sure = (F.col("p") >= MIN_P) & (F.col("share") >= MIN_SHARE)
    out = out.withColumn("confirmed", sure & (F.col("class") != "unknown")).where(F.col("confirmed") | F.col("line").rlike(f"(?i){GENERAL}"))
    return out.select("doc_id", "paragraph", F.col("line").alias("text"), F.when(sure, F.col("class")).otherwise("unknown").alias("family"), "p", "share", "confirmed")


def licence_digest(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "text", "family", F.round("p", 6).alias("p"), F.round("share", 6).alias("share"), "confirmed")
