"""Licence scanning with one generalised suffix automaton over licence templates.

The tokens of a text stream through the automaton, which yields the length of the longest template passage ending at
every token (matching statistics). Matches that end are chained per template, in order and with bounded gaps, into
covered spans; a span names its licence if it covers enough of the template. Templates are whole texts of short licences
and the notices of long ones; read_templates adds any others.
"""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import keyed, map_texts, words_of
from .tokens import per_worker

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Whole texts of the short public licences (without their copyright lines, which differ from file to file).
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_REST = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_REST = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Label and template. Whole licences first, then the notices by which longer licences say that they apply.
TEMPLATES = [
    ("mit", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_REST}"),
    ("bsd-2-clause", f"{_BSD_HEAD} {_BSD_REST}"),
    ("bsd-3-clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_REST}"),
    ("isc", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_REST}"),
    ("0bsd", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_REST}"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("boost-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", _MIT_GRANT),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
]


def read_templates(folder: str) -> list[tuple[str, str]]:
    """More templates: every file of a folder is a licence text, called by its name in lower case (as in a system's folder of common licences)."""
    return sorted((p.name.lower(), p.read_text(encoding="utf-8", errors="replace")) for p in Path(folder).iterdir() if p.is_file())


class Scanner:
    """min_match: tokens of the shortest match that counts; max_gap: tokens between chained matches; cover: share of a template that names it.

    Templates without words name nothing; several may share a label. A null text scans as an empty one.
    """

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = 3, max_gap: int = 4, cover: float = 0.8):
        self.labels = [k for k, _ in templates]
        tokens = [words_of(t) for _, t in templates]
        self.sizes = [len(t) for t in tokens]
        self.min_match, self.max_gap, self.cover = min_match, max_gap, cover
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.auto = SuffixAutomaton()
        #: By position of the joined templates: whose token it is and which of them; (None, -1) for the marks between.
        self.token: list[tuple[int | None, int]] = []
        for k, t in enumerate(tokens):
            self.auto.extend([*t, ("end", k)])
            self.token += [(k, i) for i in range(len(t))] + [(None, -1)]
        self.vocabulary = {w for t in tokens for w in t}
        # End positions of every state that a match may count for: its own and those of the states that link to it.
        longest, link = self.auto.longest, self.auto.link
        found: list[set[int]] = [set() for _ in link]
        for s in sorted((s for s in range(1, len(link)) if longest[s] >= min_match), key=lambda s: -longest[s]):
            found[s].add(self.auto.first_end[s])
            if link[s] > 0 and longest[link[s]] >= min_match:
                found[link[s]] |= found[s]
        self.places = [{p: None for p in sorted(x) if self.token[p][0] is not None} for x in found]

    def matches(self, words: list[str]):
        """(last word, length, position of its last token in the joined templates) of every passage of a template that the next word does not continue, where no longer passage ends."""
        stats = self.auto.matching(words)
        stats.append((0, 0))
        for i, (length, state) in enumerate(stats[:-1]):
            if length >= self.min_match:
                after = self.places[stats[i + 1][1]] if stats[i + 1][0] == length + 1 else {}
                for p in self.places[state]:
                    if p + 1 not in after:
                        yield i, length, p

    def spans(self, words: list[str]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template covered): the chains that cover at least `cover` of their template.

        A match continues the chain of its template that makes the most of it, among those that end at most max_gap words
        before it (what overlaps in the text counts once) at an earlier token of the template; else it begins one. One
        chain is kept for each token at which chains end, the one that covers most, so the work per match depends on the
        template and not on the text. Of chains of one template that overlap in the text the one that covers most is given.
        """
        running: dict[int, dict[int, tuple[int, int, int]]] = defaultdict(dict)
        kept: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        reach = self.max_gap + 1
        for i, length, p in self.matches(words):
            k, at = self.token[p]
            begin, t_begin, chains = i - length + 1, at - length + 1, running[k]
            best = (length, begin, i)  # tokens covered, first word, last word
            for place, (covered, first, last) in list(chains.items()):
                if begin - last > reach:  # later matches begin no earlier
                    del chains[place]
                    continue
                over = max(0, last - begin + 1)
                if over < length and place < t_begin + over and covered + length - over > best[0]:
                    best = (covered + length - over, first, i)
            if at not in chains or best[0] >= chains[at][0]:
                chains[at] = best
            if best[0] >= self.cover * self.sizes[k]:
                out = kept[k]
                if out and best[1] <= out[-1][2]:
                    if best[0] > out[-1][0]:
                        out[-1] = best
                else:
                    out.append(best)
        return [(self.labels[k], first, last, covered / self.sizes[k]) for k in sorted(kept) for covered, first, last in kept[k]]

    def places_of(self, words: list[str]) -> list[tuple[int, str]]:
        """Every place where a phrase stands."""
        out = []
        for p, label in self.phrases:
            k, i = len(p), -1
            while True:
                try:
                    i = words.index(p[0], i + 1)
                except ValueError:
                    break
                if words[i : i + k] == p:
                    out.append((i, label))
        return out

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        base = self.places_of(words)
        # Tokens outside every template end a match, so runs of known tokens are streamed one by one.
        best, found = 0.0, set()
        for begin, run in self._runs(words):
            for label, _, _, share in self.spans(run):
                found.add(label)
                best = max(best, share)
        labels = {label for _, label in base}
        if base:
            best = 1.0
        at = [i for i, _ in base]
        return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), min(1.0, best)

    def _runs(self, words: list[str]):
        """Stretches of words that hold a match: known tokens with at most max_gap unknown ones between them."""
        known = self.vocabulary
        hits = [i for i, w in enumerate(words) if w in known]
        k = 0
        while k < len(hits):
            j, solid, longest = k, 1, 1
            while j + 1 < len(hits) and hits[j + 1] - hits[j] <= self.max_gap + 1:
                solid = solid + 1 if hits[j + 1] == hits[j] + 1 else 1
                longest = max(longest, solid)
                j += 1
            if longest >= self.min_match:
                yield hits[k], words[hits[k] : hits[j] + 1]
            k = j + 1


class _Scan:
    def __init__(self, templates, phrases):
        self.args = templates, phrases

    def start(self):
        args = self.args
        scanner = per_worker(("scanner", repr(args)), lambda: Scanner(*args))
        kinds = {"r_n": pa.int64(), "r_base": pa.int64(), "r_first": pa.int64(), "r_last": pa.int64(), "r_bl": pa.string(), "r_l": pa.string(), "r_s": pa.float64()}

        def call(texts: list) -> dict:
            rows = [scanner.scan(t) for t in texts]
            return {c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())}

        return call


def scan(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels and score, under the parameters of Scanner.

    n_base counts all places of the phrases; first_word and last_word are the smallest and largest start among them
    (else null); labels adds those of covered templates; score is 1 with a phrase, else the best covered share that
    names a template, else 0. A map without a shuffle over whole texts. A null text counts as empty: no words, empty labels,
    score 0. Rows that repeat stay rows; no rows give no rows. Columns are taken by position, so others may have any name;
    a result called like the key gets an underscore.
    """
    out = map_texts(df, text_col, _Scan(templates, phrases), "r_n long, r_base long, r_first long, r_last long, r_bl string, r_l string, r_s double", [key_col])
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return keyed(out, key_col, {n: F.col(c) for c, n in zip(out.columns[1:], names)}, F.col("k0"))
