"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of terms that reveal them.

Direct identifiers are e-mail addresses, IPv4 addresses, payment cards and phone numbers, found by pattern. Each is a
protected entity. Terms are words of ``TERM_LENGTH`` letters or digits or more, lower-cased; all terms of a document co-occur
with the entities it mentions, however far away. Over all documents, with all p by documents,

    PMI(entity; term) = log p(entity, term) / (p(entity) p(term)) = IC(entity) + log p(entity | term)

and a term discloses the entity if PMI is ``DISCLOSURE`` of the entity's information content IC or more: p(entity | term)
>= p(entity) ** (1 - DISCLOSURE). At 0.9, who knows the term knows nine tenths of what the entity's mention says: so a term that
is in no document without the entity discloses it, and so does one in few others. A disclosing term is generalised at every
place of the documents that mention its entity: words to ``[TERM]``, numbers to ``[NUMBER]``; direct identifiers to their kind.
Pairs seen in fewer than ``SUPPORT`` documents are left out; at 1 none is, as most identifiers stand in one document.

Both together are in n(entity) documents at most. So a term can only disclose if it is in no more than n(entity) / p(entity) **
(1 - DISCLOSURE) documents, and terms that are in more of the documents with identifiers are not counted. The others are
counted over all documents; a bitmap of their hashes, of fixed size, keeps most words out of that count's shuffle. It drops no
term, and lets more pass the more terms there are.

Defined cases: a null text is an empty one, without spans; ``sanitise`` leaves it null. Rows with the same doc_id and text
are one document for the counts and get equal results each; the same text under another doc_id is another document. A term that
overlaps an identifier is left out. An empty table gives an empty result. Extra columns are kept by ``sanitise`` and not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import pieces, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT, DISCLOSURE, TERM_LENGTH = 1, 0.9, 3
#: Bits of the bitmap of hashes, and of one of the pieces that it is made in: 8 MB in all.
BITS, PIECE_BITS = 26, 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each domain is found by its @; the local part is the run of its characters before, back to the last match: linear in the text."""
    end = 0
    for m in _DOMAIN.finditer(text):
        a = at = m.start()
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at:
            yield a, m.end()
            end = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers, four numbers at a time: what the leftmost greedy pattern takes, in linear time."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            n = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, at + n
            at += n + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(digits := re.sub(r"[\x20-]", "", m.group())) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    return [(kind, a, b) for kind, find in FINDERS.items() for a, b in find(text)]


SCAN = "doc_id long, text_key binary, spans array<struct<kind:string,begin:int,end:int>>, entities array<long>, text string, sanitised_sha256 string"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))


def _hash64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _entity(kind: str, text: str) -> int:
    """Identifiers are equal whatever their case or separators."""
    plain = text.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text)
    return _hash64(f"{kind}:{plain}".encode())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text is kept where it has an identifier; elsewhere its own digest is that of the sanitised one."""
    for batch in pieces(batches, "text"):
        spans: list[list] = []
        entities: list[list] = []
        texts: list[str | None] = []
        digests: list[str | None] = []
        for text in batch["text"].to_pylist():
            found = base_spans(text or "")
            spans.append([{"kind": k, "begin": a, "end": b} for k, a, b in found])
            entities.append(sorted({_entity(k, text[a:b]) for k, a, b in found}))
            texts.append(text if found else None)
            digests.append(None if found or text is None else hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(spans, SPANS), pa.array(entities, pa.list_(pa.int64())), pa.array(texts, pa.string()), pa.array(digests, pa.string())], [x.name for x in batch.schema if x.name != "text"] + ["spans", "entities", "text", "sanitised_sha256"])


def _terms_of(text: str, spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, (begin, end)) of each term outside the identifiers, with the hash that ``_term_counts`` gives it."""
    free = _free(text, [(s["kind"], s["begin"], s["end"]) for s in spans])
    data, offsets = W.flat(pa.array([text[a:b].translate(_A_TO_Z) for a, b in free.tolist()], pa.string()))
    return W.hashes(data, offsets[:-1], offsets[1:]), free


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found = [np.unique(_terms_of(t, s)[0]) for t, s in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)]
        of = np.repeat(np.arange(len(found)), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([batch["text_key"].take(pa.array(of)), pa.array(np.concatenate(found).view(np.int64))], ["text_key", "term"])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of the texts with identifiers: these, and where their disclosing terms are."""
    for batch in pieces(batches, "text"):
        spans, digests = [], []
        for text, own, terms in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), batch["terms"].to_pylist(), strict=True):
            h, free = _terms_of(text, own)
            marked = free[np.isin(h.view(np.int64), np.array(terms or [], np.int64))]
            spans.append(own + [{"kind": "term", "begin": a, "end": b} for a, b in marked.tolist()])
            digests.append(hashlib.sha256(_replace(text, spans[-1]).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["text_key"], pa.array(spans, SPANS), pa.array(digests, pa.string())], ["text_key", "spans", "digest"])


def _free(text: str, found: list[tuple[str, int, int]]) -> np.ndarray:
    """(begin, end) of the terms that no identifier overlaps."""
    at = np.array([m.span() for m in _WORD.finditer(text.translate(_A_TO_Z))], np.int64).reshape(-1, 2)
    inside = np.zeros(len(text) + 1, np.int64)
    for _, a, b in found:
        inside[a] += 1
        inside[b] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(inside)[:-1] > 0)])
    return at[(covered[at[:, 1]] == covered[at[:, 0]]) & (at[:, 1] - at[:, 0] >= TERM_LENGTH)]


def _bits(rows: pa.Table) -> pa.Table:
    """A piece of the bitmap from the hashes that belong to it."""
    slot = rows["term"].to_numpy().view(W.U) & W.U((1 << PIECE_BITS) - 1)
    held = np.zeros(1 << PIECE_BITS, bool)
    held[slot.astype(np.int64)] = True
    return pa.table({"piece": rows["piece"].slice(0, 1), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})


def _bitmap(terms: DataFrame) -> np.ndarray:
    """``BITS`` bits of the hashes say where terms may be: one bit for each of 2 ** 26 groups of hashes, whatever their number."""
    piece = F.col("term").bitwiseAND(F.lit((1 << BITS) - 1))
    made = terms.select("term", F.shiftright(piece, PIECE_BITS).cast("int").alias("piece")).groupBy("piece").applyInArrow(_bits, "piece int, bits binary")
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in made.collect():  # at most 64 rows
        out[r["piece"] << PIECE_BITS - 3 : r["piece"] + 1 << PIECE_BITS - 3] = np.frombuffer(r["bits"], np.uint8)
    return out


def _term_counts(shared):
    """In how many of the documents each term is, summed over each step before anything is shuffled; only of terms in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in pieces(batches, "text"):
            data, offsets = W.flat(batch["text"])
            data = W.LOWER[data]
            start, end, bounds = W.words(data, offsets, W.ALNUM)
            h = W.hashes(data, start, end)
            slot = h & W.U((1 << BITS) - 1)
            fits = np.flatnonzero(bitmap[(slot >> W.U(3)).astype(np.int64)] >> (7 - (slot & W.U(7)).astype(np.uint8)) & 1)
            h, row = h[fits], np.searchsorted(bounds, fits, side="right")
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            terms, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("text_key"), "text")


def find_spans(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text_key (digest of the text), spans: identifiers by kind and start, then ``term`` spans by start; sanitised_sha256 of the generalised text."""
    spark, keyed = docs.sparkSession, _keyed(docs)
    found = written(keyed.mapInArrow(_scan, SCAN), "pii")
    again = written(found.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    rows, repeated = found.count(), again.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()[0]
    total = float(max(rows - repeated, 1))
    share = F.pow(F.col("n_entity") / F.lit(total), F.lit(1 - disclosure))  # what p(entity | term) has to be
    held = found.where("text is not null")
    ids = held.select("text_key", "doc_id").distinct().groupBy("text_key").agg(F.count("*").alias("n"))  # documents with the text
    first = held.groupBy("text_key").agg(*(F.first(c).alias(c) for c in ("text", "spans", "entities")))
    texts = written(first.join(ids, "text_key"), "texts")
    mentions = texts.select("text_key", "n", F.explode("entities").alias("entity"))
    entities = mentions.groupBy("entity").agg(F.sum("n").alias("n_entity")).where(F.col("n_entity") >= support)
    mentions = written(mentions.join(entities, "entity").withColumn("most", F.col("n_entity") / share * (1 + 1e-9)), "mentions")
    most = mentions.agg(F.max("most")).first()[0] or 0.0
    terms = written(texts.select("text_key", "text", "spans").mapInArrow(_terms, "text_key binary, term long"), "terms")
    wanted = written(terms.join(texts.select("text_key", "n"), "text_key").groupBy("term").agg(F.sum("n").alias("m")).where(F.col("m") <= most).select("term"), "wanted")
    count = _term_counts(spark.sparkContext.broadcast(_bitmap(wanted)))
    counts = keyed.select("text").mapInArrow(count, "term long, n long")
    if repeated:  # rows of one document count once
        more = keyed.join(again.drop("copies"), (keyed["doc_id"].eqNullSafe(again["doc_id"])) & (keyed["text_key"] == again["text_key"])).select(keyed["doc_id"], keyed["text_key"], "text")
        more = more.select("text", F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("doc_id")).alias("nth")).where("nth > 1")
        counts = counts.union(more.select("text").mapInArrow(count, "term long, n long").select("term", -F.col("n")))
    counts = counts.groupBy("term").agg(F.sum("n").alias("n_term")).where(F.col("n_term") <= most).join(wanted, "term", "left_semi")
    seen = terms.join(counts, "term").join(mentions, "text_key").where(F.col("n_term") <= F.col("most"))
    seen = written(seen.select("text_key", "term", "entity", "n", "n_term", "n_entity"), "seen")
    pairs = seen.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    revealing = pairs.where((F.col("both") >= support) & (F.col("both") / F.col("n_term") >= share)).select("entity", "term")
    marks = seen.join(revealing, ["entity", "term"]).groupBy("text_key").agg(F.collect_set("term").alias("terms"))  # one document's
    marked = texts.select("text_key", "text", "spans").join(marks, "text_key", "left").mapInArrow(_mark, "text_key binary, spans array<struct<kind:string,begin:int,end:int>>, digest string")
    marked = marked.withColumnRenamed("spans", "_spans")
    out = found.select("doc_id", "text_key", "spans", "sanitised_sha256").join(marked, "text_key", "left")
    return out.select("doc_id", "text_key", F.coalesce("_spans", "spans").alias("spans"), F.coalesce("digest", "sanitised_sha256").alias("sanitised_sha256"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "sanitised_sha256")


def _replace(text: str, spans: list[dict]) -> str:
    """Outermost spans first; a span that another covers or cuts goes with it."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["begin"], -s["end"])):
        if s["begin"] < at:
            if s["end"] > at:
                at = s["end"]
            continue
        term = text[s["begin"] : s["end"]]
        label = s["kind"].upper() if s["kind"] != "term" else "NUMBER" if term.isdigit() else "TERM"
        out += text[at : s["begin"]], f"[{label}]"
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with identifiers and disclosing terms of ``text`` generalised; all columns stay."""
    spans = find_spans(docs, support, disclosure).where(F.size("spans") > 0).select(F.col("text_key").alias("_key"), F.col("spans").alias("_spans")).dropDuplicates(["_key"])
    packed = docs.select(F.struct("*").alias("_row"), F.unhex(F.md5("text")).alias("_text_key"))
    joined = packed.join(spans, packed["_text_key"] == spans["_key"], "left")

    @F.pandas_udf("string")
    def replaced(text, found):
        import pandas as pd

        return pd.Series([t if t is None or s is None else _replace(t, list(s)) for t, s in zip(text, found, strict=True)], dtype=object)

    text = F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(replaced(F.col("_row.text"), F.col("_spans")))
    return joined.select([text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
