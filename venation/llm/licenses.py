"""Licence scans by canonical digest.

A text is made canonical, in this order: A-Z lower-cased; copyright lines dropped, and an "all rights reserved" line after one;
everything but a-z and 0-9 made white space; equivalent spellings of whole words made one; words parted by one space. The
canonical text is digested and joined by the digest to known licences. Whole texts are looked up, and so is every line by
itself, since notices stand on lines of their own. A digest matches as a whole or not at all.

A copyright line begins with the word or mark and goes on with a mark, a year, a placeholder or `by`; so a line of a
licence's own text that begins with the word, as "copyright notice and this permission notice", stays.

The known digests are a small table (those of LICENCES and DIGESTS, or the caller's). Up to MOST of them are broadcast; more
are joined as Spark sees fit. A digest that very many rows share is only ever joined to one row.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, written
from .licence_texts import DIGESTS, LICENCES, SPELLINGS, TITLES

#: Known digests up to which the table is broadcast: some 100 bytes each.
MOST = 10_000
#: Copyright lines of lower-cased text, alike to Python's and DuckDB's expressions; what goes before them is put back.
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*((copyright[ \t]*|\(c\)[ \t]*|©[ \t]*)+([0-9<\[{]|by[ \t])|copyright[ \t]*(\(c\)|©)|\(c\)[ \t]*copyright|©)[^\n]*(\n[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(?m:$))?"

_LINES = re.compile(COPYRIGHT.encode())
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPELLINGS = [(f" {a} ".replace(" ", "  ")[1:-1].encode(), f" {b} ".replace(" ", "  ")[1:-1].encode()) for a, b in SPELLINGS]
_FIRST = [a.split()[0].encode() for a, _ in SPELLINGS]


def _unmarked(folded: bytes) -> bytes:
    """Lower-cased text without copyright lines."""
    return _LINES.sub(b"\n", folded) if b"copyright" in folded or b"(c)" in folded or b"\xc2\xa9" in folded else folded


def _spelt(folded: bytes, spellings: list[tuple[bytes, bytes]]) -> bytes:
    words = folded.translate(_WORDS).split()
    if not spellings:
        return b" ".join(words)
    out = b" " + b"  ".join(words) + b" "  # two spaces, so that neighbours are each a whole word
    for a, b in spellings:
        out = out.replace(a, b)
    return out.replace(b"  ", b" ").strip()


def canonical(text: bytes) -> bytes:
    return _spelt(_unmarked(text.translate(_FOLD)), _SPELLINGS)


def canonical_lines(text: bytes) -> tuple[bytes, set[bytes]]:
    """The canonical text, and the different canonical lines by themselves."""
    folded = text.translate(_FOLD)
    used = [(a, b) for (a, b), first in zip(_SPELLINGS, _FIRST) if first in folded]
    clean = _unmarked(folded)
    lines = {_spelt(x if clean is folded else _unmarked(x), used) for x in set(folded.split(b"\n"))}
    return _spelt(clean, used), lines


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text.encode())).hexdigest()


EMPTY = hashlib.sha256(b"").hexdigest()


def known_digests() -> dict[str, str]:
    """Digest -> licence: of notices and short texts, these also below each of their titles, and of long texts."""
    out: dict[str, str] = {}
    for name, texts in LICENCES.items():
        for text in texts:
            for title in ["", *TITLES.get(name, [])]:
                out.setdefault(digest(f"{title}\n{text}"), name)
    for name, found in DIGESTS.items():
        for d in found:
            out.setdefault(d, name)
    return out


def known(spark, licences: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, licence), one row a digest: of the built-in table, or of the caller's texts by name."""
    rows = known_digests() if licences is None else {digest(t): name for name in sorted(licences, reverse=True) for t in licences[name]}
    return spark.createDataFrame(list(rows.items()), "digest string, licence string")


def _sql() -> str:
    """The same for DuckDB over documents."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def digest_sql(x: str) -> str:
        out = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        out = f"regexp_replace({out}, {quote(COPYRIGHT)}, chr(10), 'g')"
        out = f"' ' || replace(trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || ' '"
        for a, b in _SPELLINGS:
            out = f"replace({out}, {quote(a.decode())}, {quote(b.decode())})"
        return f"sha256(trim(replace({out}, '  ', ' ')))"

    rows = ", ".join(f"({quote(d)}, {quote(name)})" for d, name in known_digests().items())
    return f"""
with known as (select * from (values {rows}) as k(digest, licence)),
d as (select row_number() over () as r, doc_id, text, {digest_sql('text')} as digest from documents),
n as (select r, string_agg(distinct licence, ',' order by licence) as notices
      from (select r, {digest_sql('line')} as digest from (select r, unnest(string_split(text, chr(10))) as line from d)) l join known using (digest) group by r)
select d.doc_id, d.digest, known.licence, coalesce(n.notices, '') as notices from d left join known using (digest) left join n using (r)
"""


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the whole text) and lines (the different digests of its lines that aren't empty)."""
    ship(docs.sparkSession)

    def of(batches):
        for batch in batches:
            whole, lines = [], []
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                text, parts = canonical_lines(raw)
                whole.append(hashlib.sha256(text).hexdigest())
                lines.append([hashlib.sha256(x).digest() for x in sorted(parts - {b""})])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.string()), pa.array(lines, pa.list_(pa.binary()))], ["doc_id", "digest", "lines"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, digest string, lines array<binary>")


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """One row a document: doc_id, digest (of the whole text), licence (whose whole text it is, else null), notices (sorted licences of single lines).

    licences: digest, licence, one row a digest. Null and empty texts, and texts of copyright lines or punctuation alone, are
    canonically empty: they have the digest of the empty text and no licence. Very long texts and lines are digested whole.
    Rows that repeat an id stay rows, and each has the notices of its own text. Of two licences with one digest the caller's
    table says which. An empty table gives no rows. Extra columns are ignored.
    """
    licences = licences.where(F.col("digest") != EMPTY).select("digest", "licence")
    if licences.limit(MOST + 1).count() <= MOST:  # else Spark joins it as it sees fit
        licences = F.broadcast(licences)
    found = written(digests(docs).withColumn("row", F.monotonically_increasing_id()), "digests")  # written, so that row numbers stay
    lines = found.where("size(lines) > 0").select("row", F.explode("lines").alias("line")).select("row", F.lower(F.hex("line")).alias("digest"))
    notices = lines.join(licences, "digest").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    return found.join(licences, "digest", "left").join(notices, "row", "left").select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


SQL = _sql()
