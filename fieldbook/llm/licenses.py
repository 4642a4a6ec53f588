"""Licence scans by canonical digests, in DataFrame operations only.

A text's canonical form: lower case; copyright statements (and "all rights reserved") left out,
but not body lines that a wrap makes begin with "copyright" or "(c)";
every run of characters that are no letter or digit one space; equivalent spellings (the
published matching guidelines' word pairs) replaced by one. Its SHA-256 is looked up among
the digests of known licences, so a whole text is a licence or it is none. The same lookup
is made for every line, which finds notices such as "Released under the MIT License.".

Known texts are a small table of this package, not data; its size is checked before it is
broadcast (a larger one is joined by a shuffle). A null text has no digest and no licence; one without words has the empty form.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.license_digests import DIGESTS, MORE_NOTICES
from fieldbook.llm.license_texts import LICENSES, NOTICES

MOST_KNOWN = 10_000
#: Equivalent spellings, as words of the canonical form.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licensed", "sublicensed"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("catalogue", "catalog"), ("centre", "center"), ("cancelled", "canceled"), ("colour", "color"), ("customisation", "customization"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
]
#: Words of licence bodies that a line wrap can put behind "copyright" or "(c)"; a statement names a year, a sign or an owner there.
_BODY = r"(?:notices?|holders?|owners?|laws?|interests?|licen[sc]es?|statements?|and|or|in|on|to|of|by|permission|protection|rights?|act|treaty|treaties|similar|subject|status|disclaimers?)\b"
_ITEM = r"(?:you|under|if|any|for|to|in|where|when|each|that|this|with|its?|affirmer|no)\b"
COPYRIGHT = rf"(^|\n)[ \t*#/;-]*(copyright[ \t]+(?!{_BODY})[^\s]|copyright:|\(c\)[ \t]+(?!{_ITEM})[^\s]|©|all rights reserved)[^\n]*"
#: The SQL is as it was: it also takes body lines that begin with "copyright" for statements, and DuckDB has no lookahead.
SQL_COPYRIGHT = r"(^|\n)[ \t*#/;-]*(copyright[ \t]|copyright:|\(c\)[ \t]|©|all rights reserved)[^\n]*"


#: Whether a form holds a spelling to replace: most do not, and this is one pass.
VARIANT = " (?:" + "|".join(sorted(a for a, _ in SPELLINGS)) + ") "


def plain_form(text: Column) -> Column:
    """The words of a text between single spaces, before spellings are replaced."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT, "$1")
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _apart(words: str) -> str:
    """Words with two spaces around each, so that every word has both of its own."""
    return f" {words} ".replace(" ", "  ")


def one_spelling(form: Column) -> Column:
    """The canonical form of a plain one; ``form`` should be a column, as it is read twice.

    Words are taken apart first: no replacement uses up a space that the next word needs.
    """
    spelt = F.replace(form, F.lit(" "), F.lit("  "))
    for a, b in SPELLINGS:
        spelt = F.replace(spelt, F.lit(_apart(a)[1:-1]), F.lit(_apart(b)[1:-1]))
    return F.when(form.rlike(VARIANT), F.replace(spelt, F.lit("  "), F.lit(" "))).otherwise(form)


def canonical_form(text: str) -> str:
    """The same for a text on the driver."""
    import regex

    plain = re.sub(COPYRIGHT, r"\1", text.lower())
    form = " " + regex.sub(r"[^\p{L}\p{N}]+", " ", plain).strip(" ") + " "
    form = form.replace(" ", "  ")
    for a, b in SPELLINGS:
        form = form.replace(_apart(a)[1:-1], _apart(b)[1:-1])
    return form.replace("  ", " ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical_form(text).encode()).hexdigest()


def known_digests(texts: dict[str, list[str]]) -> dict[str, str]:
    """The licence of each known digest; of several with one digest the least name."""
    found: dict[str, str] = {}
    for name, several in texts.items():
        for text in several:
            found[digest(text)] = min(name, found.get(digest(text), name))
    return found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_digest, license_id, n_notices, notice_ids) of every row.

    license_id is the licence that the whole text is, or null; n_notices counts the lines
    that are known notices, notice_ids names them once each, sorted, joined by commas. No
    row is moved: at most ``MOST_KNOWN`` known digests are broadcast (more are joined by a
    shuffle of digests), and a row's lines are looked up in it. Whole texts are digested,
    whatever their length or number of lines. Repeated rows are scanned alike; other columns
    are ignored, whatever their names; an empty table gives no rows. A null text has no
    digest, no licence and no notice.
    """
    licenses = {d: name for name, several in DIGESTS.items() for d in several} | known_digests(LICENSES)
    notices = known_digests(MORE_NOTICES) | known_digests(NOTICES)
    table = docs.sparkSession.createDataFrame(sorted(licenses.items()), "text_digest string, license_id string")
    names = F.create_map(*[F.lit(x) for pair in sorted(notices.items()) for x in pair])
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), plain_form)
    forms = docs.select(F.col(id_col), plain_form(F.col(text_col)).alias("_form"), lines.alias("_lines"))
    digests = F.transform("_lines", lambda form: F.sha2(one_spelling(form), 256))
    rows = forms.select(
        id_col,
        F.sha2(one_spelling(F.col("_form")), 256).alias("text_digest"),
        F.transform(F.filter(digests, lambda d: d.isin(*notices)), lambda d: F.element_at(names, d)).alias("_notices"),
    )
    rows = rows.join(F.broadcast(table) if len(licenses) <= MOST_KNOWN else table, "text_digest", "left")
    return rows.select(
        id_col,
        "text_digest",
        "license_id",
        F.size("_notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("_notices")), ",").alias("notice_ids"),
    )


def oracle_sql() -> str:
    """The scan of ``documents`` as DuckDB SQL, for the texts and notices of ``license_texts``."""

    def form(text: str) -> str:
        sql = f"concat(' ', trim(regexp_replace(regexp_replace(lower({text}), '{SQL_COPYRIGHT}', '\\1', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' ')"
        sql = f"replace({sql}, ' ', '  ')"
        for a, b in SPELLINGS:
            sql = f"replace({sql}, '{_apart(a)[1:-1]}', '{_apart(b)[1:-1]}')"
        return f"sha256(replace({sql}, '  ', ' '))"

    def values(known: dict[str, str]) -> str:
        return "(VALUES " + ", ".join(f"('{d}', '{n}')" for d, n in sorted(known.items())) + ") AS v(digest, name)"

    return f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names
          FROM (SELECT doc_id, {form("line")} AS d FROM lines) JOIN {values(known_digests(NOTICES))} ON d = digest GROUP BY doc_id),
whole AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {form("text")} END AS text_digest FROM documents)
SELECT doc_id, text_digest, name AS license_id, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notice_ids
FROM whole LEFT JOIN {values(known_digests(LICENSES))} ON text_digest = digest LEFT JOIN found USING (doc_id)"""
