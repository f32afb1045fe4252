"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A passage is a run of a text's words, wherever lines break. Its coefficient with a template is twice the bigrams they
share over the bigrams of both, repeated ones counted. As sizes bound it, 2 min(a, b) / (a + b), only passages of
t / (2 - t) to (2 - t) / t times a template's size can reach a threshold t, and a text that shares fewer bigrams with a
template than that is never compared with it. That test is made for whole batches at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenfold.llm.common import bounded, narrow, released
from lumenfold.llm.normalise import plain, words
from lumenfold.llm.wordhash import codes, mix, word_hashes

# Licence notices as their stewards publish them, and short forms in common use.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."),
    ("CC0-1.0", "This work is licensed under the CC0 1.0 Universal Public Domain Dedication."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
)


@dataclass(frozen=True)
class Match:
    template: int
    first: int  # of the passage's words
    last: int
    dice: float


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.names, self.threshold = [n for n, _ in templates], threshold
        hashes, ptr = word_hashes([plain(t) for _, t in templates])
        grams = [bigrams(hashes[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
        self.bags = [Counter(g.tolist()) for g in grams]
        self.sizes = np.array([len(g) for g in grams])
        # templates that hold all of another one: the shorter one says less where a longer one passes too
        self.wholes = [[u for u, other in enumerate(self.bags) if self.sizes[u] > self.sizes[t] and bag <= other] for t, bag in enumerate(self.bags)]
        pairs = sorted({(h, t) for t, bag in enumerate(self.bags) for h in bag})
        self.keys, self.owners = np.array([h for h, _ in pairs], np.uint64), np.array([t for _, t in pairs], np.int64)
        self.distinct, self.from_ = np.unique(self.keys, return_index=True)
        self.until = np.append(self.from_[1:], len(self.keys))
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.distinct >> np.uint64(48)).astype(np.int64)] = True
        # the fewest shared bigrams in a passage that reaches the threshold: with the smallest passage that may
        self.least = np.ceil(self.threshold / (2 - self.threshold) * self.sizes - 1e-9).astype(np.int64)
        self.most = np.floor((2 - self.threshold) / self.threshold * self.sizes + 1e-9).astype(np.int64)

    def candidates(self, grams: np.ndarray, within: np.ndarray, owner: np.ndarray, texts: int) -> list[tuple[int, int]]:
        """(text, template) whose shared bigrams are enough; the work is on whole batches."""
        at = np.flatnonzero(self.quick[(grams >> np.uint64(48)).astype(np.int64)] & within)
        found = np.searchsorted(self.distinct, grams[at])
        found[found == len(self.distinct)] = 0
        real = self.distinct[found] == grams[at] if len(self.distinct) else np.zeros(len(at), bool)
        at, found = at[real], found[real]
        repeat = self.until[found] - self.from_[found] if len(found) else np.zeros(0, np.int64)
        template = self.owners[np.repeat(self.from_[found], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)] if len(found) else np.zeros(0, np.int64)
        pair, count = np.unique(np.repeat(owner[at], repeat) * len(self.sizes) + template, return_counts=True)
        text, template = pair // len(self.sizes), pair % len(self.sizes)
        keep = count >= self.least[template]
        return list(zip(text[keep].tolist(), template[keep].tolist(), strict=True))

    def passages(self, grams: list[int], template: int) -> Iterator[Match]:
        """For each place where a shared bigram may begin a passage, the passage with the largest coefficient."""
        bag, size, most = self.bags[template], int(self.sizes[template]), int(self.most[template])
        hits = [i for i, g in enumerate(grams) if g in bag]
        for n, first in enumerate(hits):
            used, best = Counter(), None
            shared = 0
            for at in hits[n:]:
                if at - first >= most:
                    break
                used[grams[at]] += 1
                shared += used[grams[at]] <= bag[grams[at]]
                dice = 2 * shared / (size + at - first + 1)
                if dice >= self.threshold and (best is None or dice > best.dice):
                    best = Match(template, first, at + 1, dice)
            if best:
                yield best

    def matches(self, grams: list[int], templates: list[int]) -> list[Match]:
        """Passages that don't overlap: the best first, then of the largest template, then from the left.

        A passage yields to one around it of a template that holds all of its own.
        """
        found = sorted((m for t in templates for m in self.passages(grams, t)), key=lambda m: (-m.dice, -self.sizes[m.template], m.first, m.template))
        taken, out = np.zeros(len(grams) + 1, bool), []
        by_template: dict[int, list[Match]] = {}
        for m in found:
            by_template.setdefault(m.template, []).append(m)
        for m in found:
            if any(x.first <= m.first and m.last <= x.last for u in self.wholes[m.template] for x in by_template.get(u, ())):
                continue
            if not taken[m.first : m.last + 1].any():
                taken[m.first : m.last + 1] = True
                out.append(m)
        return sorted(out, key=lambda m: m.first)


def bigrams(hashes: np.ndarray) -> np.ndarray:
    factor = codes(2, 20)
    return mix(hashes[:-1] * factor[0] + hashes[1:] * factor[1]) if len(hashes) > 1 else np.empty(0, np.uint64)


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """A row for each licence passage of a whole text: id, license, start, end (code points), n_words, dice.

    Null and empty texts have none; a null id is reported as null; repeated rows are scanned each; further columns
    are not read; an empty table gives no rows. Ties go to the larger template, then to the first in the list. No
    shuffle; the templates are a parameter, so what tasks hold doesn't grow with the input.
    """
    known = Templates(templates, threshold)
    schema = pa.schema([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("dice", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            texts = batch.column("text").to_pylist()
            hashes, ptr = word_hashes([plain(t) for t in texts])
            grams, owner = bigrams(hashes), np.repeat(np.arange(len(texts)), np.diff(ptr))
            by_text: dict[int, list[int]] = {}
            for text, template in known.candidates(grams, owner[:-1] == owner[1:], owner, len(texts)):
                by_text.setdefault(text, []).append(template)
            rows, owners = [], []
            for i, found in by_text.items():
                matches = known.matches(grams[ptr[i] : ptr[i + 1] - 1].tolist(), found)
                spans = words(texts[i]) if matches else []
                for m in matches:
                    rows.append({"license": known.names[m.template], "start": spans[m.first][1], "end": spans[m.last][2], "n_words": m.last - m.first + 1, "dice": m.dice})
                    owners.append(i)
            out = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owners, pa.int64())), *out.columns], names=["id", *schema.names])

    source = narrow(df, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(released(run), f"id {kind}, license string, start bigint, end bigint, n_words bigint, dice double").withColumnRenamed("id", id_col)
