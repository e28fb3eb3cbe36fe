"""Licence scan by canonical digests, in DataFrame code only.

A text is brought to a canonical form: lower case; copyright and all-rights
lines out; equivalent spellings (the usual matching guidelines: licence and
license, ``&`` and ``and``, ``http`` and ``https``, ``per cent`` and so on) made
one; punctuation to blanks; runs of blanks to one.  The SHA-256 of that form is
joined with the digests of known licences: once for the whole text of a
document, and once for each of its lines, which finds notices.

The list of known texts is broadcast; it is refused beyond ``MAX_KNOWN``.

Defined results: null text and text whose canonical form is empty match
nothing; repeated rows get equal results; of several names with one canonical
form the first in code point order is told; an empty table gives an empty
result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_KNOWN = 20_000

_PERMISSIVE_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Short public texts and notices (fixed values), those of the oracle; :func:`default_known` adds the data files.
KNOWN = {
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _PERMISSIVE_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END,
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC0-1.0-notice": "Released under CC0 1.0 Universal.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
}

#: Signs that count as one, replaced before punctuation goes.
SIGNS = [("https://", "http://"), ("&", " and ")]
#: Spellings that count as one, over words between single blanks; they start at a word's start, and end at one's end where a blank ends them.
EQUIVALENT = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("per cent ", "percent "),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("organisation", "organization"),
    ("whilst", "while"),
]
#: Lines that hold only who owns the rights, and since when.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n©(]*(?:(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9])[^\n]*|all rights reserved[^\p{L}\n]*)$"

#: What follows "copyright" in prose, so that a wrapped line of it stays.
_PROSE = r"(?!(?i:holders?|owners?|licen[sc]es?|notices?|laws?|acts?|treat\w*|statements?|interests?|and|or|in|on|is|to|of|for)\b)"
#: Lines of owners without sign or year: a capitalised name or a placeholder after the word, or any case if it ends as owners do.
OWNER_LINE = (
    r"(?m)^[^\p{L}\n©(]*(?:Copyright[ \t:]+" + _PROSE + r"(?:(?:by|By)\b|(?:the|The)[ \t]+\p{Lu}|(?!The\b)\p{Lu})[^\n]*"
    r"|(?i:copyright)[ \t:]*[\[{<][^\n]*"
    r"|(?i:copyright)[ \t:]+" + _PROSE + r"[^\n]*\b(?i:authors?|contributors?|developers|maintainers|team|project|foundation|inc|llc|ltd|corp|corporation|company|gmbh)\b[^\p{L}\n]*)$"
)


def default_known() -> dict[str, str]:
    """:data:`KNOWN` and the whole texts of the data files, by file name; a caller's own list replaces them."""
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return KNOWN | {f.stem: f.read_text(encoding="utf-8") for f in files}


def canonical(text: Column) -> Column:
    """Lower-cased words between single blanks; line ends stay, for each line that is left."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, OWNER_LINE, "")), COPYRIGHT_LINE, "")
    for old, new in SIGNS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def spelled(words: Column) -> Column:
    """Words of one line with equivalent spellings made one."""
    out = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(" " + old), F.lit(" " + new))
    return F.trim(out)


def _one_line(form: Column) -> Column:
    """A canonical form as words between single blanks, spelled alike."""
    return spelled(F.regexp_replace(form, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: Mapping[str, str]) -> DataFrame:
    """(digest, license) of the known texts, with the length of their form."""
    if len(known) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known texts")
    rows = spark.createDataFrame(list(known.items()), "license string, text string")
    form = rows.select("license", _one_line(canonical(F.col("text"))).alias("form"))
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("form")).alias("chars"))


def scan(docs: DataFrame, known: Mapping[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license (of the whole text, or null), notices (of its lines, sorted, joined by commas, or null) of every row."""
    found = known_digests(docs.sparkSession, default_known() if known is None else known).persist()
    longest = found.agg(F.max("chars")).first()[0] or 0
    names = F.broadcast(found.select("digest", F.col("license").alias("name")))
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("form")).withColumn("whole", _one_line(F.col("form")))
    # A form longer than the longest known one needs no digest of its own; that loses nothing.
    short = (F.length("whole") > 0) & (F.length("whole") <= longest)
    rows = rows.select("id", F.md5("form").alias("key"), "form", F.when(short, F.sha2("whole", 256)).alias("whole_digest"))
    lines = rows.select("key", F.explode(F.split("form", "\n")).alias("line")).withColumn("line", spelled(F.col("line")))
    lines = lines.where((F.length("line") > 0) & (F.length("line") <= longest)).select("key", F.sha2("line", 256).alias("digest"))
    # Few lines match; what matched is kept by the text's key, so copies of a text share it.
    notices = lines.join(names, "digest").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices"))
    out = rows.drop("form").join(names, F.col("whole_digest") == F.col("digest"), "left").drop("digest")
    return out.join(notices, "key", "left").select(F.col("id").alias(id_col), F.col("name").alias("license"), "notices")
