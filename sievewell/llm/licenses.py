"""Licence scans: canonical digests of whole texts, looked up among those of known licences.

Canonical form: small letters; copyright notices dropped; everything but letters and digits
made one blank; variant spellings made one. The digest of the form is joined with a table
of known digests, for the whole text and for each of its lines, so a licence text is found
as a document and a notice as a line. Only Spark's own functions are used.

Known are the texts of ``KNOWN`` and the whole texts in the folder ``known_licenses``, with
and without their titles and the instructions after their terms.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.session import broadcast_if_small, written_once

# Spellings that mean the same in licence texts.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyright holder": "copyright owner", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "non commercial": "noncommercial",
    "non infringement": "noninfringement", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sub license": "sublicense", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Short licences in full, and notices that name one.
KNOWN = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ),
]
# A notice is a line. It names a sign or a year right after the word, or opens a paragraph without being a sentence
# about copyright, or is such a line, or the sentence that reserves all rights, right after another notice. A line of
# a licence's body that a wrap has begun with the word is none. No group is repeated: a matcher would recurse for each line.
_ABOUT = "notice|holder|owner|law|licen[sc]e|statement|interest|protection|right|act|treat|disclaimer|permission|and|or|in|is|as|to|of|are|for|shall|may"
_SIGNED = r"(?:©|copyright[ \t:,]*(?:\(c\)|©|&copy;|[\[<{(]?(?:yyyy|year)|(?:19|20)[0-9][0-9])|\(c\)[ \t]*(?:copyright|©|(?:19|20)[0-9][0-9]))[^\n]*"
_NAMED = rf"copyright\b(?![ \t]+(?:{_ABOUT})s?\b)[^\n]*"
_RESERVED = r"all rights reserved[ \t\r.]*(?=\n|$)"
MARK = "\x01"  # stands for a notice until all are found
NOTICES = [
    (rf"(?i)(^|\n)[ \t]*+{_SIGNED}", f"$1{MARK}"),
    (rf"(?i)(^[ \t\r\n]*+|\n[ \t\r]*+\n[ \t]*+){_NAMED}", f"$1{MARK}"),
    (rf"(?i)(?:{MARK}|\G(?!^))\n[ \t]*+(?:{_NAMED}|{_RESERVED}|{MARK})", f"\n{MARK}"),  # \G: where the notice before has ended
]

# Titles above texts that are known without one.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "The Expat License", "MIT License (Expat)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "Unlicense": ["Unlicense", "The Unlicense", "Unlicense (Public Domain)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The 2-Clause BSD License", "BSD License"],
    "BSD-3-Clause": [
        "BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "The 3-Clause BSD License", "BSD License",
    ],
    "BSL-1.0": [],
}
_THIRD = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ADDRESSES = [
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA",
]
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA")
_FIRSTS = sorted({v[0] for v in SPELLINGS})
# the variants by their first letters, so that most words are passed at one look
_VARIANT = " (?:" + "|".join(f"{a}(?:" + "|".join(sorted(v[1:] for v in SPELLINGS if v[0] == a)) + ")" for a in _FIRSTS) + ") "


def _plain(text: Column) -> Column:
    """Letters and digits in small letters, with one blank between. Only A-Z have small letters: other signs are blanks before."""
    # a single blank, which is most of what there is to replace, is left as it is
    return F.lower(F.trim(F.regexp_replace(text, " *[^A-Za-z0-9 ][^A-Za-z0-9]*| {2,}", " ")))


def with_canonical(rows: DataFrame, text: str, into: str) -> DataFrame:
    """``rows`` with the canonical form of the column ``text``; null gives an empty one.

    Each step is a column of its own, so that none is worked out twice; only a text with
    a word or sign of copyright is searched for notices.
    """
    rows = rows.withColumn("__text", F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(" "))).withColumn("__plain", _plain(F.col("__text")))
    cut = F.col("__text")
    for pattern, one in NOTICES:
        cut = F.regexp_replace(cut, pattern, one)
    marked = F.col("__plain").contains("copyright") | F.concat(F.lit(" "), "__plain", F.lit(" ")).contains(" c ") | F.col("__text").contains("©")
    rows = rows.withColumn("__cut", F.when(marked, _plain(cut)).otherwise(F.col("__plain")))
    spelled = F.col("__cut")
    for variant, one in SPELLINGS.items():
        spelled = F.regexp_replace(spelled, rf"\b{variant}\b", one)
    return rows.withColumn(into, F.when(F.concat(F.lit(" "), "__cut", F.lit(" ")).rlike(_VARIANT), spelled).otherwise(F.col("__cut"))).drop("__text", "__plain", "__cut")


def canonical_text(text: str) -> str:
    """The same in plain Python, line by line, from which the SQL takes its digests."""
    out, run, blank = [], False, True  # in a run of notices; at the start of a paragraph
    for line in re.split(r"\n", text):
        low = line.lower().lstrip(" \t")
        named = re.match(_NAMED, low) is not None
        run = re.match(_SIGNED, low) is not None or (named and (run or blank)) or (run and re.match(rf"(?:{_RESERVED})", low) is not None)
        out.append("" if run else line)
        blank = not run and not line.strip(" \t\r")
    plain = re.sub("[^A-Za-z0-9]+", " ", "\n".join(out)).strip(" ").lower()
    for variant, one in SPELLINGS.items():
        plain = re.sub(rf"\b{variant}\b", one, plain)
    return plain


@cache
def known_texts() -> list[tuple[str, str]]:
    """``KNOWN`` and the whole texts of the folder, in the forms in which they stand as files."""
    bodies = [x for x in KNOWN if len(x[1]) > 200 and x[0] in TITLES and x[0] != "Unlicense"]
    out = list(KNOWN)
    for file in sorted(files("sievewell.llm").joinpath("known_licenses").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        if name in TITLES:
            bodies.append((name, text))
            continue
        parts = re.split(r"\n\s*\n", text.strip(), maxsplit=2)
        texts = [text, text.strip()[len(parts[0]) :]]  # with and without the title
        if len(parts[1].strip()) < 60:
            texts.append(parts[2])
        ends = [re.split(r"(?<=END OF TERMS AND CONDITIONS)", t)[0] for t in texts]
        plain = [t.removesuffix("END OF TERMS AND CONDITIONS") for t in ends]
        for t in {*texts, *ends, *plain}:
            out += [(name, _ADDRESS.sub(a, t)) for a in _ADDRESSES] if _ADDRESS.search(t) else []
            out.append((name, t))
    two = next(t for name, t in bodies if name == "BSD-2-Clause")
    head, rest = two[two.index("Redistribution and use") :].split("THIS SOFTWARE IS PROVIDED", 1)
    for whom in ("the copyright holder", "copyright holder", "the copyright holders", "the University", "the author", "the authors", "the project"):
        bodies.append(("BSD-3-Clause", f"{head}\n3. {_THIRD.format(whom)}\n\nTHIS SOFTWARE IS PROVIDED{rest}"))
    # the same texts with other marks before their clauses, other makers, and other links
    for name, t in list(bodies):
        if name.startswith("BSD"):
            bodies.append((name, re.sub(r"(?m)^\s*[123][.)]\s", "* ", t)))
        if name == "ISC":
            bodies.append((name, t.replace("and/or distribute", "and distribute")))
            bodies.append((name, t.replace("THE AUTHOR", "ISC")))
        if name == "Unlicense":
            bodies += [(name, re.sub(r"https?://(www\.)?unlicense\.org/?", link, t)) for link in ("https://unlicense.org", "https://www.unlicense.org", "")]
            bodies.append((name, t[: t.index("For more information")]))
    for name, t in list(bodies):
        if name.startswith("BSD"):
            bodies.append((name, re.sub(r"THE COPYRIGHT\s+HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS", t).replace("COPYRIGHT HOLDER OR", "REGENTS OR")))
    for name, t in bodies:
        out += [(name, t), *((name, f"{title}\n\n{t}") for title in TITLES[name])]
    return out


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id, first) of (license_id, text); of several names for one text the first stays, empty texts are none.

    ``first`` lists the words with which a text of this form can begin, before its spelling is changed.
    """
    forms = with_canonical(known.select("license_id", F.col("text").cast("string").alias("text")), "text", "form").where("form <> '' AND license_id IS NOT NULL")
    start = F.substring_index("form", " ", 1)
    others = [F.when(start == one.split(" ")[0], F.lit(variant.split(" ")[0])) for variant, one in SPELLINGS.items()]
    forms = forms.withColumn("first", F.array_compact(F.array_distinct(F.array(start, *others))))
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min("first").alias("first"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest, license_id, notices.

    ``digest`` is that of the whole canonical text, ``license_id`` the licence whose text
    it is, or null. ``notices`` names the licences of single lines that are a known text,
    in order and divided by commas; empty if there are none. Only lines that begin with a
    word with which a known text can begin are put in canonical form, which loses none.
    A null or empty text, or one without letters and digits, has the digest of the empty form and matches nothing.
    Rows that repeat give one row each, also without id; other columns do not matter, an
    empty table gives no rows. ``known`` (license_id, text) is broadcast if it is counted
    to be small, and joined by a shuffle otherwise.
    """
    if known is None:
        known = docs.sparkSession.createDataFrame(known_texts(), "license_id string, text string")
    table = written_once(known_digests(known), "known-licenses")
    firsts = broadcast_if_small(table.select(F.explode("first").alias("first")).distinct(), 100_000)
    table = broadcast_if_small(table.drop("first"), 100_000)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    lines = rows.select("doc_id", "text_key", F.explode(F.split("text", "\n")).alias("line"))
    # the first word, without a look at the rest of the line; a line that is a notice has none
    lines = lines.withColumn("first", F.lower(F.regexp_extract("line", "^[^A-Za-z0-9]*([A-Za-z0-9]+)", 1))).join(firsts, "first")
    lines = with_canonical(lines.select("doc_id", "text_key", "line"), "line", "form")
    # never null, so that the join brings no test for null under the steps, which would work the form out once more
    lines = lines.select("doc_id", "text_key", F.coalesce(F.sha2("form", 256), F.lit("")).alias("digest")).join(table, "digest")
    notices = lines.groupBy("doc_id", "text_key").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    notices = notices.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_text"), "notices")
    whole = with_canonical(rows, "text", "form").select("doc_id", "text_key", F.sha2("form", 256).alias("digest")).join(table, "digest", "left")
    out = whole.join(notices, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_text")), "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def spelled_sql(plain: str) -> str:
    for variant, one in SPELLINGS.items():
        plain = f"regexp_replace({plain}, '\\b{variant}\\b', '{one}', 'g')"
    return plain


def scan_sql() -> str:
    """The scan in DuckDB's SQL, with the digests of all known texts; notices are found line by line, by windows over the lines."""
    digests: dict[str, str] = {}
    for name, text in known_texts():
        if form := canonical_text(text):
            digest = hashlib.sha256(form.encode()).hexdigest()
            digests[digest] = min(name, digests.get(digest, name))
    values = ", ".join(f"('{d}', '{name}')" for d, name in sorted(digests.items()))
    signed, about = _SIGNED.replace("[^\\n]*", ""), rf"^[ \t]*copyright[ \t]+(?:{_ABOUT})s?\b"
    plain = lambda text: f"lower(trim(regexp_replace({text}, '[^A-Za-z0-9]+', ' ', 'g')))"
    return rf"""
WITH known AS (
  SELECT * FROM (VALUES {values}) AS t(digest, license_id)
), rows AS (
  SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(1), ' ') AS text FROM documents
), split AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM rows
), kinds AS (
  SELECT r, i, line, regexp_matches(line, '^[ \t]*{signed}', 'i') AS signed,
         regexp_matches(line, '^[ \t]*copyright\b', 'i') AND NOT regexp_matches(line, '{about}', 'i') AS named,
         regexp_matches(line, '^[ \t]*all rights reserved[ \t\r.]*$', 'i') AS reserved, regexp_matches(line, '^[ \t\r]*$') AS blank
  FROM split
), runs AS (
  SELECT *, sum(CASE WHEN signed OR named OR reserved THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run, lag(blank, 1, true) OVER (PARTITION BY r ORDER BY i) AS opens FROM kinds
), marked AS (
  SELECT r, i, line, (signed OR named OR reserved) AND bool_or(signed OR (named AND opens)) OVER (PARTITION BY r, run ORDER BY i) AS notice, signed OR named AS alone FROM runs
), texts AS (
  SELECT r, {spelled_sql(plain("string_agg(CASE WHEN notice THEN '' ELSE line END, chr(10) ORDER BY i)"))} AS form FROM marked GROUP BY r
), notices AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM marked JOIN known ON digest = sha256({spelled_sql(plain("line"))}) WHERE NOT alone GROUP BY r
)
SELECT rows.doc_id, sha256(form) AS digest, license_id, coalesce(notices, '') AS notices
FROM rows JOIN texts USING (r) LEFT JOIN known ON known.digest = sha256(form) LEFT JOIN notices USING (r)
"""
