"""License scans by a positional index of rare words; DataFrame functions only.

Besides the plain phrases, the scan knows licence notices as templates. Their words, but for common ones outside the key
phrase, are the postings: word, template, position. One pass over all texts counts the words of each file and in how many files each word of a key phrase
stands. Each template is looked up by the word of its key phrase that has the highest inverse document frequency, so that no template
hangs on what other notices a file has: each place of that word in a file implies a start of the template. There all postings of the template are
intersected with the file's words by relative position; the template is found where its whole key phrase stands at its place
and at least LEAST_SHARE of all its posted words are in place, which share is its score. Identifiers of the SPDX list are templates of their own.

Only files that hold every word of some key phrase or plain phrase are read again; the counts of the first pass tell which.

Defined results: null and empty texts have no words, no places, empty labels and score 0; rows that repeat a doc_id, or have none,
are judged one by one; an empty table gives an empty table; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound, hinted, row_key, settled, words_of

#: The plain phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices by label, the key phrase in brackets.
TEMPLATES = {
    "gpl-2.0": "licensed under the [gnu general public license version 2]",
    "gpl-3.0": "licensed under the [gnu general public license version 3]",
    "lgpl-2.1": "licensed under the [gnu lesser general public license version 2 1]",
    "lgpl-3.0": "licensed under the [gnu lesser general public license version 3]",
    "agpl-3.0": "licensed under the [gnu affero general public license version 3]",
    "gpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license as published by
        the free software foundation] either version 3 of the license or at your option any later version this program is distributed in the hope that it will
        be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose""",
    "lgpl-notice": """this library is free software you can redistribute it and or modify it under the terms of the [gnu lesser general public license as published by
        the free software foundation] either version 2 1 of the license or at your option any later version""",
    "agpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the [gnu affero general public license as published by
        the free software foundation] either version 3 of the license or at your option any later version""",
    "apache-2.0": "licensed under the [apache license version 2 0]",
    "apache-notice": """licensed under the apache license version 2 0 the license [you may not use this file except in compliance with the license] you may obtain a copy of the
        license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied""",
    "mit-license": "released under the [mit license]",
    "mit-notice": """[permission is hereby granted free of charge to any person obtaining a copy of this software] and associated documentation files the software to deal in
        the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the software""",
    "bsd": """[redistribution and use in source and binary forms with or without modification are permitted] provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form
        must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials""",
    "bsd-3-clause": """nor the names of its contributors [may be used to endorse or promote products derived from this software without specific prior written permission]""",
    "isc": """[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies""",
    "zlib": """[this software is provided as is without any express or implied warranty in no event will the authors be held liable] for any damages arising from the use of
        this software permission is granted to anyone to use this software for any purpose including commercial applications""",
    "unlicense": "this is [free and unencumbered software released into the public domain] anyone is free to copy modify publish use compile sell or distribute this software",
    "mpl-2.0": """this source code form is subject to the terms of the [mozilla public license v 2 0] if a copy of the mpl was not distributed with this file you can obtain one""",
    "epl-2.0": "made available under the terms of the [eclipse public license v 2 0]",
    "cddl-1.0": "[common development and distribution license version 1 0]",
    "boost-1.0": "distributed under the [boost software license version 1 0]",
    "artistic-2.0": "the [artistic license 2 0]",
    "eupl-1.2": "licensed under the [european union public licence v 1 2]",
    "cc0-1.0": "[cc0 1 0 universal]",
    "cc-by-3.0": "licensed under [cc by 3 0]",
    "cc-by-4.0": "licensed under [cc by 4 0]",
    "cc-by-sa-3.0": "licensed under [cc by sa 3 0]",
    "cc-by-sa-4.0": "licensed under [cc by sa 4 0]",
    "cc-by-nc-4.0": "licensed under [cc by nc 4 0]",
    "cc-by-nd-4.0": "licensed under [cc by nd 4 0]",
    "cc-by-notice": "licensed under a [creative commons attribution 4 0 international license]",
    "cc-by-sa-notice": "licensed under a [creative commons attribution sharealike 4 0 international license]",
}
#: Identifiers of the SPDX list, by the words that they are.
IDENTIFIERS = (
    "mit", "apache 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "bsd 2 clause", "bsd 3 clause", "isc", "mpl 2 0", "epl 2 0", "cddl 1 0", "bsl 1 0", "artistic 2 0", "eupl 1 2", "cc0 1 0",
    "cc by 3 0", "cc by 4 0", "cc by sa 3 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nd 4 0", "unlicense", "zlib",
)
TEMPLATES |= {f"spdx:{'-'.join(name.split())}": f"[spdx license identifier {name}]" for name in IDENTIFIERS}
TEMPLATES |= {
    "gpl-v2": "[gnu general public license v2]",
    "gpl-v3": "[gnu general public license v3]",
    "lgpl-v2.1": "[gnu lesser general public license v2 1]",
    "lgpl-v3": "[gnu lesser general public license v3]",
    "agpl-v3": "[gnu affero general public license v3]",
    "bsd-2-clause-name": "the [bsd 2 clause license]",
    "bsd-3-clause-name": "the [bsd 3 clause license]",
    "isc-name": "the [isc license]",
    "mpl-v2": "[mozilla public license v 2 0]",
    "mpl-version-2": "[mozilla public license version 2 0]",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of
        source code must retain the above copyright notice [this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce] the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
        by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness
        for a particular purpose are disclaimed""",
    "wtfpl": "[do what the fuck you want to public license] terms and conditions for copying distribution and modification",
}
#: A notice is found where at least this share of its posted words stands in place.
LEAST_SHARE = 0.5

#: Words too common to be posted.
COMMON = ("a", "and", "any", "are", "for", "in", "is", "of", "or", "the", "this", "to", "use", "with", "without", "under")


def postings() -> list[tuple[str, str, int, bool]]:
    """(word, template, position, whether it belongs to the key phrase) of all posted words."""
    out = []
    for label, notice in sorted(TEMPLATES.items()):
        inside = False
        for at, word in enumerate(notice.split()):
            inside |= word.startswith("[")
            if (bare := word.strip("[]")) not in COMMON or inside:
                out.append((bare, label, at, inside))
            inside &= not word.endswith("]")
    return out


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    posted = postings()
    keys = {t: sorted({q[0] for q in posted if q[1] == t and q[3]}) for t in TEMPLATES}
    phrases = {label: p.split() for p, label in PHRASES.items()}
    vocabulary = sorted({w for ws in [*keys.values(), *phrases.values()] for w in ws})
    key = row_key("doc_id", "text")

    # One pass over all texts: word counts, and the words of key phrases that each file holds.
    split = docs.select("doc_id", key.alias("key"), words_of(F.lower(F.col("text"))).alias("w"))
    narrow = settled(split.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.array_intersect("w", _texts(vocabulary)).alias("held")))
    df = dict(narrow.select(F.explode("held").alias("word")).groupBy("word").count().collect())  # at most the vocabulary
    rarest = {t: min(keys[t], key=lambda w: (df.get(w, 0), w)) for t in TEMPLATES}

    # The files that hold all words of a phrase, with their words.
    whole = F.lit(False)
    for ws in [*keys.values(), *phrases.values()]:
        whole = whole | (F.size(F.array_except(_texts(ws), "held")) == 0)
    few = hinted(settled(narrow.where(whole).select("key").distinct()))
    files = docs.select(key.alias("key"), "text").join(few, "key", "left_semi").dropDuplicates(["key"]).select("key", words_of(ascii_lower(F.col("text"))).alias("w"))

    # The index is a constant of the query: some hundred postings, looked up inside each row.
    starts, listed = {}, {}
    for w, t, at, in_key in posted:
        listed.setdefault(t, []).append({"word": w, "place": at, "in_key": in_key})
        if in_key and w == rarest[t]:
            starts.setdefault(w, []).append({"label": t, "place": at})
    index = F.from_json(F.lit(json.dumps(starts)), "map<string, array<struct<label string, place int>>>")
    template = F.from_json(F.lit(json.dumps(listed)), "map<string, array<struct<word string, place int, in_key boolean>>>")

    def places(words: Column, phrase: str) -> Column:
        first, *rest = phrase.split()

        def stands(w: Column, i: Column) -> Column:
            good = w == first
            for j, x in enumerate(rest, 1):
                good = good & (F.coalesce(F.get(words, i + j), F.lit("")) == x)
            return good

        return F.filter(F.transform(words, lambda w, i: F.when(stands(w, i), i)), lambda i: i.isNotNull())

    def look_up(words: Column) -> Column:
        at = [places(words, p).alias(label) for p, label in PHRASES.items()]
        rare = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(sorted(starts)))
        votes = F.flatten(F.transform(rare, lambda x: F.transform(index[x["word"]], lambda p: F.struct(p["label"].alias("label"), (x["at"] - p["place"]).alias("start")))))

        def intersect(vote: Column) -> Column:
            stands = F.transform(template[vote["label"]], lambda p: F.struct(F.coalesce(F.get(words, vote["start"] + p["place"]) == p["word"], F.lit(False)).alias("here"), p["in_key"].alias("in_key")))

            def judged(fits: Column) -> Column:
                missing = F.exists(fits, lambda f: f["in_key"] & ~f["here"])
                return F.struct(vote["label"].alias("label"), missing.alias("missing"), (F.size(F.filter(fits, lambda f: f["here"])) / F.size(fits)).alias("share"))

            return bound(stands, judged)

        found = F.filter(F.transform(votes, intersect), lambda x: ~x["missing"] & (x["share"] >= LEAST_SHARE))
        return F.struct(F.struct(*at).alias("places"), found.alias("found"))

    read = files.select("key", bound(F.col("w"), look_up).alias("x")).select("key", "x.*")
    every = F.flatten(F.array(*[F.col(f"places.`{label}`") for label in PHRASES.values()]))
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"places.`{label}`") > 0, F.lit(label)) for label in PHRASES.values()])))
    judged = read.select(
        "key",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        base.alias("base"),
        F.transform("found", lambda x: x["label"]).alias("found"),
        F.array_max(F.transform("found", lambda x: x["share"])).alias("share"),
    )
    out = narrow.select("doc_id", "key", "n_words").join(hinted(settled(judged)), "key", "left")
    nothing = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.coalesce("base", nothing), F.coalesce("found", nothing)))
    n_base = F.coalesce("n_base", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.coalesce("base", nothing), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"),
    )
