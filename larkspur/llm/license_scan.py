"""Licence recognition by sentence rules: known sentences become identifiers, ordered identifier sequences become licences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches, texts_of
from .common import ship

#: Identifier of a sentence and its wording, from the licences' published texts and usual notices.
SENTENCES = [
    ("apache-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-spdx", "SPDX-License-Identifier: Apache-2.0"),
    ("mit-short", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-spdx", "SPDX-License-Identifier: MIT"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("bsd-redistribute", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl3-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl3-spdx", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ccbync-short", "Licensed under CC BY-NC 4.0."),
    ("ccby-short", "Licensed under CC BY 4.0."),
    ("cc0-short", "This work is dedicated to the public domain under CC0 1.0."),
    ("mpl-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("rights", "All rights reserved."),
    ("gpl2-redistribute", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl21-redistribute", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3-redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("ccby-international", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ccbysa-international", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ccbync-international", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("ccbysa-short", "Licensed under CC BY-SA 4.0."),
    ("epl2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]
#: Identifiers that a line 'SPDX-License-Identifier:' may name, alone or joined by OR, AND and WITH.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
#: Licence, then the ordered identifiers that show it.  Of rules that fit at one place the longest counts.
RULES = [
    ("Apache-2.0", ["apache-header", "apache-copy"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-spdx"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-spdx"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("GPL-3.0", ["gpl-redistribute", "gpl-hope"]),
    ("GPL-3.0", ["gpl-redistribute"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-3.0", ["gpl3-spdx"]),
    ("CC-BY-NC-4.0", ["ccbync-short"]),
    ("CC-BY-4.0", ["ccby-short"]),
    ("CC0-1.0", ["cc0-short"]),
    ("MPL-2.0", ["mpl-form"]),
    ("all-rights-reserved", ["rights"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-2.0", ["gpl2-redistribute"]),
    ("LGPL-2.1", ["lgpl21-redistribute"]),
    ("LGPL-3.0", ["lgpl3-redistribute"]),
    ("AGPL-3.0", ["agpl3-redistribute"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("CC-BY-4.0", ["ccby-international"]),
    ("CC-BY-SA-4.0", ["ccbysa-international"]),
    ("CC-BY-SA-4.0", ["ccbysa-short"]),
    ("CC-BY-NC-4.0", ["ccbync-international"]),
    ("EPL-2.0", ["epl2-terms"]),
]
_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+\-() \t]+)")
_NAME = re.compile(r"[a-z0-9][a-z0-9.+\-]*")
#: Licence of an identifier: its own name, without the suffix that says which versions hold, for the licences that rules name so.
_FAMILIES = {x.lower(): re.sub(r"-(?:only|or-later)$", "", x) for x in SPDX}
_WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*")


def normal(sentence: str) -> str:
    """Words in lower case, one blank between them; marks, list numbers and line breaks don't count."""
    out = _WORD.findall(sentence.lower())
    while len(out) > 1 and len(out[0]) <= 2 and out[0].isdigit():
        out = out[1:]
    return " ".join(out)


class Known:
    """Known sentences by their words: what follows a first word is tried only where a known sentence begins."""

    def __init__(self, sentences: list[tuple[str, str]], rules: list[tuple[str, list[str]]]):
        self.ids: dict[str, str] = {}
        for name, s in sentences:
            self.ids[normal(s)] = name
        self.first = {k.split(" ", 1)[0] for k in self.ids}
        starts = sorted({x.lower() for x in self.first}, key=len, reverse=True)
        self.hint = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, starts)) + r")(?![a-z0-9])")
        self.rules = sorted(rules, key=lambda r: -len(r[1]))
        self.longest = max(len(k.split(" ")) for k in self.ids)

    def sentences(self, text: str) -> list[tuple[int, str]]:
        """(place, identifier) of known sentences, in order.  A sentence begins at a line's or sentence's start and may
        run over line breaks; it ends where a sentence or a line ends, and of several ends the last known one counts."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer: places are those of the lower text
            text = low
        out, upto = [], 0
        for m in self.hint.finditer(low):
            at = m.start()
            if at < upto or not starts_sentence(low, at):
                continue
            words: list[str] = []
            best = None
            for w in _WORD.finditer(low, at):
                words.append(w[0])
                if len(words) > self.longest:
                    break
                if name := self.ids.get(" ".join(words)):
                    end = w.end()
                    if end >= len(low) or ends_sentence(low, end):
                        best = (name, end)
            if best:
                out.append((at, best[0]))
                upto = best[1]
        return out

    def expressions(self, text: str) -> list[str]:
        """Licences that SPDX lines name, whatever joins them; unknown names count for nothing."""
        low = text.lower()
        if "spdx-license-identifier:" not in low:
            return []
        return [_FAMILIES[n] for m in _EXPRESSION.finditer(low) for n in _NAME.findall(m[1]) if n in _FAMILIES]

    def licences(self, ids: list[str]) -> list[str]:
        """From left to right, the longest rule that the sequence goes on with; other identifiers are passed over."""
        out, k = [], 0
        while k < len(ids):
            fit = next((r for r in self.rules if ids[k : k + len(r[1])] == r[1]), None)
            if fit:
                out.append(fit[0])
            k += len(fit[1]) if fit else 1
        return out


def starts_sentence(low: str, at: int) -> bool:
    """Is only a list mark or a quote between the place and a line's start or a sentence's end?"""
    k = at - 1
    while k >= 0 and low[k] in " \t\"'*#/-(":
        k -= 1
    return k < 0 or low[k] in "\n\r.!?:;|"


def ends_sentence(low: str, end: int) -> bool:
    """Marks, then white space, a line's end or the text's."""
    k = end
    while k < len(low) and low[k] in ".!?:;)/\"'":
        k += 1
    return k == len(low) or low[k] in "\n\r" or (k > end and low[k].isspace())


def scan_licences(docs: DataFrame, sentences: list[tuple[str, str]] | None = None, rules: list[tuple[str, list[str]]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, sentence_ids array<string>, licences array<string>, n_licences) of every row; whole texts.

    sentence_ids has the known sentences in order, licences the distinct licences in order of their names: those of rules and
    those that SPDX lines name.  An empty table gives no rows, and other columns aren't read.  Null and empty texts have empty arrays.  Repeated rows give repeated rows.  No shuffle: a document is read by one task.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    tables = (sentences or SENTENCES, rules or RULES)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(*tables)
        for whole in it:
            for b in batches(whole):
                texts = list(texts_of(b.column(1)))
                found = [[name for _, name in known.sentences(t)] for t in texts]
                got = [sorted({*known.licences(x), *known.expressions(t)}) for x, t in zip(found, texts, strict=True)]
                strings = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, strings), pa.array(got, strings), pa.array(list(map(len, got)), pa.int32())], ["key", "sentence_ids", "licences", "n_licences"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(rows, f"key {kind}, sentence_ids array<string>, licences array<string>, n_licences int").withColumnRenamed("key", key)
