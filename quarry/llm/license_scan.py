"""Licence scan: text units compared with licence templates by the Dice coefficient over word bigrams.

Units are the lines, the paragraphs (parted by blank lines) and the whole text
of every document; templates of ``LONG`` bigrams or more, which are printed as
several paragraphs, also meet every run of 2 to ``RUN`` consecutive paragraphs.
A unit and a template are normalised alike (A-Z lowered,
anything but a-z and 0-9 made a blank) and compared by 2 |A n B| / (|A| + |B|)
over their sets of word bigrams.  For a coefficient of t or more the sizes must
satisfy t / (2 - t) <= |A| / |B| <= (2 - t) / t, and at least
|B| t / (2 - t) bigrams must be shared.  The second bound finds the few units
worth normalising from hashes of all bigrams of a slice of text; the first
prunes templates for each of them; the coefficient itself is computed on words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import bytes_prefix, mix, slices, span_hash, text_column

THRESHOLD = 0.8
RUN = 8                         # paragraphs in a run, at most
LONG = 60                       # bigrams from which a template meets runs of paragraphs

# Public licence notices, (id, text).
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. ")
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. ")
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES = (
    ("BSD-2-Clause", _BSD_TERMS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
     "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
     "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
     "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations under "
     "the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
     "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
     "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
     "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
     "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior "
     "written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
     "option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
     "to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_KEEP = re.compile(rb"[a-z0-9]+")
_BLANK_LINES = re.compile(rb"\n[ \t\r]*\n")


def bigrams(text: bytes) -> set[tuple[bytes, bytes]]:
    words = _KEEP.findall(text.lower())
    return set(zip(words, words[1:]))


def _unit_hits(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the template bigrams met in a slice, by hash; ``place`` is the first word's byte."""
    empty = np.zeros(0, dtype=np.int64)
    if not len(data):
        return empty, empty
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    w = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    head, tail = w.copy(), w.copy()
    head[1:] &= ~w[:-1]
    tail[:-1] &= ~w[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    head[edge] = w[edge]
    tail[edge - 1] = w[edge - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    if len(starts) < 2:
        return empty, empty
    h = span_hash(bytes_prefix(low), starts, ends)
    pair = mix(h[:-1] * np.uint64(3) ^ h[1:])
    hit = np.flatnonzero(np.isin(pair, table))
    row = np.searchsorted(offs, starts[hit], side="right") - 1
    same = ends[hit + 1] <= offs[row + 1]
    return row[same], starts[hit][same]


def _hashed(pairs: set) -> np.ndarray:
    """Hashes of template bigrams as :func:`_unit_hits` computes them."""
    out = []
    for a, b in sorted(pairs):
        data = np.frombuffer(a + b, dtype=np.uint8)
        h = span_hash(bytes_prefix(data), np.array([0, len(a)]), np.array([len(a), len(a) + len(b)]))
        out.append(mix(h[:1] * np.uint64(3) ^ h[1:])[0])
    return np.array(out, dtype=np.uint64)


def scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row per document: id, license, score, n_licenses, licenses.

    ``licenses`` are the ids of all templates that some unit matches, in order;
    ``license`` and ``score`` are the best match, ties to the id first in
    order; null, 0.0 and an empty list where nothing matches, as for null and
    empty texts.  Repeated rows and null ids are scanned like any other; an
    empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = [(name, bigrams(text.encode())) for name, text in templates]
    least = threshold / (2 - threshold)
    table = np.unique(_hashed(set().union(*(b for _, b in known))))
    few = min(len(b) for _, b in known) * least      # shared bigrams that any match needs
    whole = [(name, b) for name, b in known if len(b) >= long]
    many_needed = min((len(b) for _, b in whole), default=0) * least
    widest = max((len(b) for _, b in whole), default=0) / least

    def match(own: set, templates: list, best: dict) -> None:
        for name, other in templates:
            if least * len(other) <= len(own) <= len(other) / least:
                score = 2 * len(own & other) / (len(own) + len(other))
                if score >= threshold and score > best.get(name, 0.0):
                    best[name] = score

    def units(text: bytes, places: np.ndarray, best: dict) -> None:
        """Matches the units with enough hits: lines, paragraphs, the text; then runs of paragraphs."""
        lines = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10)
        gaps = np.array([m.end() for m in _BLANK_LINES.finditer(text)], dtype=np.int64)
        seen, sizes = set(), {}
        for cuts in (lines + 1, gaps, np.zeros(0, dtype=np.int64)):
            of = np.searchsorted(cuts, places, side="right")
            which, many = np.unique(of, return_counts=True)
            bounds = np.concatenate(([0], cuts, [len(text)]))
            for u in which[many >= few].tolist():
                span = int(bounds[u]), int(bounds[u + 1])
                if span not in seen:
                    seen.add(span)
                    own = bigrams(text[span[0]:span[1]])
                    sizes[span] = len(own)
                    match(own, known, best)
        if whole and len(gaps) and len(places) >= many_needed:
            bounds = np.concatenate(([0], gaps, [len(text)]))
            upto = np.searchsorted(places, bounds)

            def fits(i: int) -> bool:
                """Whether paragraph i alone leaves room for a match of a run that holds it."""
                span = int(bounds[i]), int(bounds[i + 1])
                if span not in sizes:
                    sizes[span] = len(bigrams(text[span[0]:span[1]]))
                return sizes[span] <= widest

            for k in range(2, min(RUN, len(gaps) + 1) + 1):
                for i in np.flatnonzero(upto[k:] - upto[:-k] >= many_needed).tolist():
                    if all(fits(j) for j in range(i, i + k)):
                        match(bigrams(text[int(bounds[i]):int(bounds[i + k])]), whole, best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = [{} for _ in range(batch.num_rows)]
            for a, _, data, offs in slices(text_column(batch)):
                row, place = _unit_hits(data, offs, table)
                heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
                for i, j in zip(heads.tolist(), np.append(heads[1:], len(row)).tolist()):
                    if j - i < few:
                        continue
                    r = int(row[i])
                    text = data[offs[r]:offs[r + 1]].tobytes()
                    units(text, place[i:j] - offs[r], found[a + r])
            best = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (None, 0.0) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([b[0] for b in best], type=pa.string()),
                 pa.array([b[1] for b in best], type=pa.float64()), pa.array([len(f) for f in found], type=pa.int64()),
                 pa.array([sorted(f) for f in found], type=pa.list_(pa.string()))],
                names=["id", "license", "score", "n_licenses", "licenses"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, license string, score double, n_licenses bigint, licenses array<string>")
            .withColumnRenamed("id", id_col))


def oracle_sql(templates: tuple = TEMPLATES, threshold: float = THRESHOLD, long: int = LONG) -> str:
    """The same scan of ``documents`` in DuckDB SQL, without the pruning; licenses joined by commas."""
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''"))
                       for i, (name, text) in enumerate(templates))
    norm = ("trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            "'[^a-z0-9]+', ' ', 'g'))")
    return f"""
WITH tpl AS (SELECT * FROM (VALUES {values}) v(tid, name, body)),
tpl_words AS (SELECT tid, name, string_split({norm.format('body')}, ' ') AS w FROM tpl),
tpl_pairs AS (SELECT DISTINCT tid, name, w[i] || ' ' || w[i + 1] AS pair
              FROM (SELECT tid, name, w, unnest(range(1, len(w))) AS i FROM tpl_words)),
tpl_size AS (SELECT tid, name, count(*) AS b FROM tpl_pairs GROUP BY ALL),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents),
para AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS unit FROM documents),
paras AS (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS p FROM documents),
starts AS (SELECT doc_id, p, k, unnest(range(1, len(p) - k + 2)) AS i
           FROM paras CROSS JOIN (SELECT unnest(range(2, {RUN + 1})) AS k) WHERE len(p) >= k),
runs AS (SELECT doc_id, array_to_string(p[i:i + k - 1], ' ') AS unit FROM starts),
units AS (SELECT doc_id, unit, run, row_number() OVER () AS u FROM (
              SELECT doc_id, unit, false AS run FROM line UNION ALL SELECT doc_id, unit, false FROM para
              UNION ALL SELECT doc_id, text, false FROM documents UNION ALL SELECT doc_id, unit, true FROM runs)),
words AS (SELECT doc_id, u, run, string_split({norm.format('unit')}, ' ') AS w FROM units WHERE unit IS NOT NULL),
pairs AS (SELECT DISTINCT doc_id, u, run, w[i] || ' ' || w[i + 1] AS pair
          FROM (SELECT doc_id, u, run, w, unnest(range(1, len(w))) AS i FROM words)),
sizes AS (SELECT u, count(*) AS a FROM pairs GROUP BY u),
shared AS (SELECT doc_id, u, tid, count(*) AS c FROM pairs JOIN tpl_pairs USING (pair) JOIN tpl_size USING (tid)
           WHERE NOT run OR b >= {long} GROUP BY ALL),
scored AS (SELECT doc_id, name, max(2.0 * c / (a + b)) AS score FROM shared JOIN sizes USING (u) JOIN tpl_size USING (tid)
           WHERE 2.0 * c / (a + b) >= {threshold} GROUP BY ALL),
best AS (SELECT doc_id, first(name ORDER BY score DESC, name) AS license, max(score) AS score, count(*) AS n_licenses,
                string_agg(name, ',' ORDER BY name) AS licenses FROM scored GROUP BY doc_id)
SELECT d.doc_id, b.license, coalesce(b.score, 0.0)::DOUBLE AS score, coalesce(b.n_licenses, 0)::BIGINT AS n_licenses,
       coalesce(b.licenses, '') AS licenses
FROM documents d LEFT JOIN best b USING (doc_id)"""
