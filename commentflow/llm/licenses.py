"""Licence scan by canonical digests.

A text and each of its lines are units. A unit is made canonical: ASCII lower
case, copyright lines left out, equivalent spellings unified, punctuation and
white space collapsed. Its digest is then looked up, by a hash join, among the
digests of the known licence texts and notices, which are made canonical by the
same expression. Only whole units match: a licence inside a longer line, or one
with a changed word, does not. Units that lack a stem which every known form holds
cannot match and are left out before.

Known are the full texts in ``known_licenses`` as published (with and without title,
preamble or appendix), the MIT, ISC and BSD texts, and one-line notices. The full
texts of AGPL-3.0, CC-BY-NC, CC-BY-ND and CC-BY-NC-SA are not in the table.

The known table is a parameter of fixed size (below 200 rows), so it is broadcast
and no text is shuffled. Null and empty texts and units without a letter or digit
match nothing; repeated rows give repeated matches; a text of one line is reported
as text and as line. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings that count as equal, as (pattern, spelling) on canonical words.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"), ("catalogue", "catalog"),
    ("centre", "center"), ("cheque", "check"), ("copyright owner", "copyright holder"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("optimisation", "optimization"),
    ("organisation", "organization"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)

_PERMISSIVE = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
# Licence texts and notices by SPDX identifier.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software. " + _PERMISSIVE),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
     "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
     "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
)

_ISC_OLD = KNOWN[1][1].replace("and/or", "and")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
# Titles that stand before a text, or none.
_TITLED = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD License",
                     "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "FreeBSD License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD License",
                     "New BSD License", "Modified BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
}
_FOLDER = Path(__file__).parent / "known_licenses"
# Addresses of the Free Software Foundation in the GPL 2, in its head and in its appendix.
_FSF = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "675 Mass Ave, Cambridge, MA 02139, USA",
)


def _published() -> list[tuple[str, str]]:
    """Licence texts in the forms in which they are published."""
    bodies = [("MIT", KNOWN[0][1]), ("ISC", KNOWN[1][1]), ("ISC", _ISC_OLD)]
    for a, b, c in (("", "", ""), ("1. ", "2. ", "3. ")):
        bodies += [("BSD-2-Clause", _BSD.format(a, b, "")), ("BSD-3-Clause", _BSD.format(a, b, c + _NAMES))]
    out = [(i, f"{title}\n\n{body}") for i, body in bodies for title in _TITLED[i] if title or body not in (KNOWN[0][1], KNOWN[1][1])]
    for file in sorted(_FOLDER.glob("*.txt")):
        name, text = file.stem, file.read_text("utf-8")
        forms = [text]
        if name == "GPL-2.0-only":
            forms = [text.replace(_FSF[0], a) for a in _FSF]
            web = text.replace(f",\n {_FSF[0]}", "\n <https://fsf.org/>")
            forms.append(re.sub(r"write to the Free Software Foundation, Inc\.,\s+51 .*USA\.", "see <https://www.gnu.org/licenses/>.", web))
        # Each without its title, its appendix, or both.
        end = {"GPL-2.0-only": "How to Apply These Terms", "GPL-3.0-only": "How to Apply These Terms",
               "Apache-2.0": "APPENDIX: How to apply", "MPL-2.0": "Exhibit A - Source Code Form",
               "CC-BY-4.0": "=====================", "CC-BY-SA-4.0": "====================="}.get(name)
        begin = {"GPL-2.0-only": "Everyone is permitted", "GPL-3.0-only": "Everyone is permitted", "LGPL-3.0-only": "Everyone is permitted",
                 "Apache-2.0": "TERMS AND CONDITIONS FOR USE", "MPL-2.0": "1. Definitions", "CC0-1.0": "CC0 1.0 Universal",
                 "CC-BY-4.0": "Creative Commons Attribution 4.0", "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0"}[name]
        forms += [f[: f.rindex(end)] for f in forms if end]
        if name == "Apache-2.0":
            forms.append(forms[-1].replace("END OF TERMS AND CONDITIONS", ""))
            forms.append(text[text.rindex("Licensed under the Apache"):])  # the notice of the appendix
        if name == "MPL-2.0":
            notice = text[text.index("This Source Code Form is subject"):]
            forms.append(re.split(r"\n\s*\n", notice)[0])
        if name.startswith("CC-BY"):
            forms += [f"Creative Commons {f}" for f in forms]
        forms += [f[f.index(begin):] for f in forms if begin in f]
        out += [(name, f) for f in dict.fromkeys(forms)]
    return out


KNOWN = (*KNOWN, *_published())

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Comment marks, a copyright line with year, sign or placeholder; comment words alone.
COPYRIGHT = (
    r"(?:^|\n)[^\p{L}\p{N}\n]*(?:(?:dnl|rem)\b[^\p{L}\p{N}\n]*)?"
    r"(?:(?:copyright\b[^\n]*(?:\(c\)|©|[0-9]{4}|[<\[{]|all rights reserved)|\(c\)|©)[^\n]*"
    r"|all rights reserved[^\p{L}\p{N}\n]*(?m:$))|(?:^|\n)[ \t]*(?:dnl|@?rem)\b"
)
# Clauses of known texts whose number looks like a copyright sign.
CLAUSES = ("you must retain", "under patent claims")
MARKS = r"[^\p{L}\p{N}]+"
# Every known text holds one of these; others are tried only if a known text does not.
STEMS = ("licen", "permission", "redistribut")
# Names of holders in the BSD texts, and what stands for them.
BSD = "redistribution and use in source"
HOLDERS = (
    (r" neither the names? of [^.]{1,200}? nor the names? of [^.]{0,60}?contributors ", " neither the name of the copyright holder nor the names of its contributors "),
    (r" this software is provided by [^.]{1,200}? as is and any ", " this software is provided by the copyright holders and contributors as is and any "),
    (r" in no event shall [^.]{1,200}? be liable for any direct ", " in no event shall the copyright holder or contributors be liable for any direct "),
)


def canonical(text: str, flag: str = "") -> tuple[str, str, str]:
    """SQL for the canonical form of ``text`` before spellings, a pattern of the
    spellings, and SQL that unifies them in ``_u``. ``flag`` is an engine's argument
    for replacing every match, where it needs one."""
    def quoted(s: str) -> str:
        return "'" + (s if flag else s.replace("\\", "\\\\")) + "'"

    out = f"translate({text}, '{UPPER}', '{LOWER}')"
    for clause in CLAUSES:
        out = f"replace({out}, '(c) {clause}', 'c {clause}')"
    newline = "chr(10)"
    out = f"regexp_replace({out}, {quoted(COPYRIGHT)}, {newline}{flag})"
    out = f"trim(regexp_replace(replace({out}, '&', ' and '), {quoted(MARKS)}, ' '{flag}))"
    words = "|".join([*(old for old, _ in SPELLINGS), BSD])
    unified = "_u"
    for old, new in HOLDERS:
        unified = f"regexp_replace({unified}, {quoted(old)}, '{new}'{flag})"
    for old, new in SPELLINGS:
        unified = f"replace({unified}, ' {old} ', ' {new} ')"
    return out, words, unified


def _canonical_rows(units: DataFrame) -> DataFrame:
    """Add ``_digest`` of ``_unit``; units without a word are dropped. ``_hinted`` says
    whether the canonical form holds one of the stems.

    Each step stands behind a generator: filters are pushed through projections, which
    would repeat the whole chain in every one of them, but not through generators.
    """
    out, words, unified = canonical("_unit")
    plain = units.select(
        *[c for c in units.columns if c != "_unit"], F.explode(F.array(F.expr(f"concat(' ', {out}, ' ')"))).alias("_u")
    ).filter("_u <> '  '")
    # Only units that hold one of the spellings pay for unifying them.
    digest = F.md5(F.expr(f"if(_u RLIKE ' (?:{words}) ', {unified}, _u)"))
    return plain.select("*", F.col("_u").rlike("|".join(STEMS)).alias("_hinted"), F.explode(F.array(digest)).alias("_digest")).drop("_u")


def known_digests(spark, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """Digests of the known texts: (_digest, license), each once."""
    if len(known) > 10_000:
        raise ValueError("the table of known licences is broadcast: at most 10,000 rows")
    rows = spark.createDataFrame(list(known), "license string, _unit string")
    return _canonical_rows(rows).dropDuplicates(["_digest"])


def _hint(known: DataFrame) -> str:
    """A pattern that a unit must match to be one of the known texts, or one that all do.

    Canonical forms keep the letters of a unit in a row (spellings keep the stems), so
    where every known form holds a stem, so does the raw text of every match.
    """
    return f"(?i){'|'.join(STEMS)}" if known.filter("NOT _hinted").isEmpty() else "(?s)^"


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """One row per unit that is a known licence: the kept columns, ``unit`` (text or
    line), ``line`` (its place from 0, null for the text) and ``license``."""
    own = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    digests = known_digests(docs.sparkSession, known)
    hint = _hint(digests)
    lines = F.filter(
        F.transform(F.split(F.col("_text"), "\n"), lambda x, i: F.struct(i.cast("bigint").alias("line"), x.alias("_unit"))),
        lambda unit: unit["_unit"].rlike(hint),
    )
    whole = F.array(F.struct(F.lit(None).cast("bigint").alias("line"), F.col("_text").alias("_unit")))
    units = docs.select(*own, F.col(text).alias("_text")).filter(F.col("_text").rlike(hint)).select(
        *[f"_keep_{i}" for i in range(len(keep))], F.inline(F.concat(whole, lines))
    )
    found = _canonical_rows(units).drop("_hinted").join(F.broadcast(digests.select("_digest", "license")), "_digest")
    return found.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.when(F.col("line").isNull(), "text").otherwise("line").alias("unit"), "line", "license",
    )
