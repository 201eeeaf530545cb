"""Secret scans with corpus-wide ownership frequency.

Base patterns find assigned secrets, access keys and long hexadecimal strings.
A wider candidate pattern finds other key-like strings; most of those are
harmless, so their values' hashes are counted over the whole corpus by distinct
owners and repositories. A value is a widely copied example if a large share of
the corpus' owners and many of its repositories hold it, or a large share of all
repositories, whoever owns them; another looks like a live credential and is
added as a span: a key that leaked to a few owners is not an example. A text
counts once, however many copies of it stand in however many sources: copying a
document does not make its key an example.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.graph import join_unique
from corpusloom.llm.memory import released, sliced
from corpusloom.session import cut_lineage, ship_package

KINDS = ("assign", "access", "hex", "live")
OWNER_SHARE = 1 / 4            # of all owners: a value of more of them, and of more than
MANY_REPOSITORIES = 1 / 100_000  # of all repositories, is a widely copied example,
REPOSITORY_SHARE = 1 / 100     # and so is one of more of all repositories,
LEAST_REPOSITORIES = 1000      # if they are more than this: fewer show no habit of a corpus
LEAST_ENTROPY = 3.2     # bits per character of a key-like string
MASK = "[SECRET]"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_KEY = re.compile(r"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_=-]{20,}")

Span = tuple[int, int, int, str]  # start, kind, end, value


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def other_keys(text: str, known: list[Span]) -> list[Span]:
    """Key-like strings outside the base spans: letters and digits mixed, high entropy."""
    found = []
    for m in _KEY.finditer(text):
        value = m[0]
        digits = sum(c.isdigit() for c in value)
        letters = sum(c.isalpha() for c in value)
        if digits < 3 or letters < 3 or entropy(value) < LEAST_ENTROPY:
            continue
        if not any(start < m.end() and m.start() < end for start, _, end, _ in known):
            found.append((m.start(), 3, m.end(), value))
    return found


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_CANDIDATE = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())])
_SCANNED = (
    "doc_id long, owner string, repository string, text_a long, text_b long, n_assign long, n_access long, n_hex long, "
    "base_sha256 string, found array<struct<start: long, kind: int, end: long, hash: long>>"
)


def scan(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """Stored: one row per document with all candidates of its whole text."""

    def find(batches):
        for batch in sliced(batches):
            columns: list[list] = [[], [], [], [], []]
            for text in batch["text"]:
                text = text.as_py() or ""
                base = base_spans(text)
                kinds = Counter(kind for _, kind, _, _ in base)
                for k in range(3):
                    columns[k].append(kinds[k])
                joined = ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in base)
                columns[3].append(hashlib.sha256(joined.encode()).hexdigest())
                columns[4].append([
                    {"start": start, "kind": kind, "end": end, "hash": _hash(value)}
                    for start, kind, end, value in base + other_keys(text, base)
                ])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "owner", "repository", "text_a", "text_b")),
                 *[pa.array(c, pa.int64()) for c in columns[:3]],
                 pa.array(columns[3], pa.string()), pa.array(columns[4], pa.list_(_CANDIDATE))],
                ["doc_id", "owner", "repository", "text_a", "text_b", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    text = F.col("text").cast("string")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"), text.alias("text"),
        F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b"),
    )
    return cut_lineage(narrow.mapInArrow(released(find), _SCANNED).withColumn("row", F.monotonically_increasing_id()))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, owners, repositories; every distinct text counts once.

    ``owners``: so many owners are enough to hold all distinct texts with the
    value (1 if one owner has them all, whoever has copies of them too).
    ``repositories``: distinct ones, a text standing in the first of its own.
    Counts are combined map-side in every step, so a value that a third of all
    rows hold is counted before it moves.
    """
    repository = F.struct(F.col("repository").isNull().alias("none"), "repository")
    held = candidates.groupBy("hash", "text_a", "text_b", "owner").agg(F.min(repository).alias("repository"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("texts")).groupBy("hash").agg(
        F.count("*").alias("some"), F.max("texts").alias("most"))
    by_text = held.groupBy("hash", "text_a", "text_b").agg(F.min("repository").alias("repository")).groupBy(
        "hash", "repository").agg(F.count("*").alias("texts")).groupBy("hash").agg(
        F.count("*").alias("repositories"), F.sum("texts").alias("texts"))
    return by_owner.join(by_text, "hash").select(
        "hash", F.least(F.col("some"), 1 + F.col("texts") - F.col("most")).alias("owners"), "repositories"
    )


def is_live(rows: DataFrame, max_owners: int | None = None, max_repositories: int | None = None) -> Column:
    """Whether counts of ``ownership`` are those of a live credential among ``rows``.

    A value is copied if more than ``max_owners`` owners and many repositories
    hold it, or more than ``max_repositories`` repositories. Limits that are not
    given follow the corpus (see the constants); one owner is never many.
    """
    everyone, everything = (rows.select(name).distinct().count() for name in ("owner", "repository"))
    owners = max(1.0, OWNER_SHARE * everyone) if max_owners is None else max_owners
    most = max(LEAST_REPOSITORIES, REPOSITORY_SHARE * everything) if max_repositories is None else max_repositories
    many = (F.col("owners") > owners) & (F.col("repositories") > MANY_REPOSITORIES * everything)
    return ~(many | (F.col("repositories") > most))


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id",
                 max_owners: int | None = None, max_repositories: int | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    ``spans``: kind:start:end of all base spans and of the key-like strings that
    are live (see ``ownership`` and ``is_live``), by start, then kind, comma-joined.
    ``n_live`` and ``n_copied`` count the document's spans (base ones too) whose
    value is owner-specific or widely copied. A null text is empty; a null owner
    or repository is one of its own; repeated rows are documents each but count
    once; an empty table gives no row.
    """
    ship_package(docs.sparkSession)
    rows = scan(docs, owner, repository)
    candidates = cut_lineage(rows.select(
        "row", "owner", "repository", "text_a", "text_b", F.explode("found").alias("f")
    ).select("row", "owner", "repository", "text_a", "text_b", "f.*"))
    live = is_live(rows, max_owners, max_repositories)
    judged = join_unique(candidates.select("row", "start", "kind", "end", "hash"), cut_lineage(ownership(candidates)), "hash")
    span = F.struct("start", "kind", "end")
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(live | (F.col("kind") < 3), span)).alias("kept"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    written = F.transform(F.array_sort("kept"), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    ))
    return rows.drop("found").join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(written, ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with every span replaced; overlapping spans become one mask."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id",
                 max_owners: int | None = None, max_repositories: int | None = None) -> DataFrame:
    """The documents with all their secrets masked; ``n_chars`` follows the text.

    Base spans follow from the text alone. Values of key-like strings that are
    live are looked up per document id.
    """
    ship_package(docs.sparkSession)
    rows = scan(docs, owner, repository)
    candidates = cut_lineage(rows.select(
        "doc_id", "owner", "repository", "text_a", "text_b", F.explode("found").alias("f")
    ).select("doc_id", "owner", "repository", "text_a", "text_b", "f.*"))
    owned = cut_lineage(ownership(candidates).filter(is_live(rows, max_owners, max_repositories)))
    keys = candidates.filter("kind = 3").select("doc_id", "hash")
    live = join_unique(keys, owned, "hash").select(F.col("doc_id").alias("l_id"), "hash").groupBy("l_id").agg(
        F.collect_set("hash").alias("live"))
    columns, own_name = docs.columns, "live"
    while own_name in columns:
        own_name += "_"
    given = docs.select(F.struct("*").alias("given"), F.col("doc_id").cast("long").alias("id"))  # columns of any names
    wide = given.join(live, F.col("id").eqNullSafe(F.col("l_id")), "left").select("given.*", F.col("live").alias(own_name))

    def mask(batches):
        for batch in sliced(batches):
            texts = []
            for text, own in zip(batch["text"], batch[own_name], strict=True):
                text, own = text.as_py(), set(own.as_py() or ())
                if text:
                    base = base_spans(text)
                    spans = [(s, e) for s, _, e, _ in base]
                    if own:
                        spans += [(s, e) for s, _, e, v in other_keys(text, base) if _hash(v) in own]
                    text = masked(text, spans) if spans else text
                texts.append(text)
            at = batch.schema.names.index("text")
            arrays = [*batch.columns]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays[:-1], batch.schema.names[:-1])

    out = wide.mapInArrow(released(mask), docs.schema)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(
            F.col("text").contains(MASK), F.char_length("text").cast(kind)
        ).otherwise(F.col("n_chars")))
    return out
