"""Removal of word passages that an earlier document holds, over a De Bruijn graph of word windows.

Edges are k-mers of `window` words. A window is taken off a document if the same words start in a document of smaller
id. All edges of a corpus are too many to shuffle, so it goes in steps, each a co-grouped join on the same parts of the
documents (hash parts, dealt out once and read again from the same exchange):

1. Minimizers: of the runs of MINIMIZER words inside a window the one of least hash (rightmost of equals). Equal windows
   have equal minimizers, and neighbouring windows mostly share theirs, so these runs are about a fifth of the windows.
   Each part sends each of its minimizers once; buckets answer which are in more than one part.
2. Edges: windows whose minimizer is repeated (in another part, or in two documents of the part). Each part sends each
   edge once, with the coordinates (document, row, position) of its first occurrence; buckets answer, with the coordinates
   of the first of all, which edges start in an earlier document of another part.
3. Compaction: joined to their documents, edges that follow each other here and at their source, so that both
   coordinates advance in step, are one nonbranching path (document, start, words, source document, source start).
4. Verification: each part asks the parts of its sources for its distinct paths, by coordinates and a digest of the words
   that it has. The source's part reads the words at those coordinates and answers which digests agree.
5. The words of verified paths are removed. A path that isn't verified, as after a collision of hashes, stays in the text.

What is sent is one entry for each part and distinct key, so a passage that a third of all documents hold costs a bucket,
and the part of its source, no more entries than there are parts. Edges are found by 96 bits of two polynomial hashes over
the words' 64-bit hashes; what is removed rests on 128-bit BLAKE2 digests of the words themselves. Parts and buckets are
as many as the shuffle has partitions, or more, so that none holds more than PART_BYTES or BUCKET_BYTES of text.

Defined results: a null or blank text has no words and no windows; rows with a null id lose nothing and are nobody's
source; rows with one id don't take words from each other; windows are judged on the input; extra columns pass through.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import WORD_RE, column, partitions

WINDOW, MINIMIZER = 13, 5
PARTS_FOR_A_PARTITION = 2
#: Most UTF-8 bytes of text in a part (one Python worker's group), and behind a bucket's keys.
PART_BYTES, BUCKET_BYTES = 16 << 20, 128 << 20
#: A place in a part is row << ROW_SHIFT | position.
ROW_SHIFT = 36
DIGEST = 16
MIX, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

ANSWER = "part int, kind int, bucket int, bits binary, source binary, at binary, home binary"
SENT = "bucket int, part int, keys binary, more binary, doc binary, at binary"
#: kind 3 asks for paths, 4 are a part's own paths, 5 answers which of those asked for agree.
TOLD = "to int, part int, kind int, doc binary, at binary, words binary, source binary, home binary, place binary, more binary"


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes, all first bytes before all second ones: the shuffle's compression then finds the empty ones."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(b: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _polynomial(h: np.ndarray, n: int, length: int, base: np.uint64) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out *= base
        out += h[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of keys: sorted keys fall into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(keys: np.ndarray, buckets: int):
    """(bucket, begin, end) of sorted keys."""
    edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
    return [(b, edges[b], edges[b + 1]) for b in np.unique(_bucket(keys, buckets)).tolist()]


def _order(ids: list, texts: list) -> list[int]:
    """Row numbers by id and text: the same whatever order a shuffle delivers rows in."""
    return sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or ""))


class Part:
    """The words, minimizers and edges of the documents of one part, in order of their ids."""

    def __init__(self, ids: list, texts: list, window: int, minimizer: int):
        self.order = _order(ids, texts)
        self.window = window
        self.words: list[bytes] = []
        ends = []
        for k in self.order:
            self.words += (texts[k] or "").encode().split()
            ends.append(len(self.words))
        self.ends = np.array(ends, dtype=np.int64)
        self.begins = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.ids = np.array([0 if ids[k] is None else ids[k] for k in self.order], dtype=np.int64)
        self.h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        n = max(len(self.h) - window + 1, 0)
        doc = np.repeat(np.arange(len(ends)), self.ends - self.begins)
        self.starts = np.nonzero(doc[:n] == doc[window - 1 :])[0] if n else np.zeros(0, np.int64)  # where a window lies in one document
        if None in ids:
            nameless = np.array([ids[k] is None for k in self.order])
            self.starts = self.starts[~nameless[doc[self.starts]]]
        self.doc = doc
        runs = _polynomial(self.h, max(len(self.h) - minimizer + 1, 0), minimizer, MIX)
        least = runs[:n].copy()
        for j in range(1, window - minimizer + 1):
            np.minimum(least, runs[j : j + n], out=least)
        self.minimizer = least[self.starts]
        new = np.ones(len(self.starts), dtype=bool)
        new[1:] = (self.minimizer[1:] != self.minimizer[:-1]) | (doc[self.starts[1:]] != doc[self.starts[:-1]])
        values, owners = self.minimizer[new], doc[self.starts[new]]
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        first = np.ones(len(values), dtype=bool)
        first[1:] = values[1:] != values[:-1]
        at = np.nonzero(first)[0]
        self.minimizers = values[at]
        self.shared = np.maximum.reduceat(owners, at) != owners[at] if len(at) else np.zeros(0, bool)  # by documents of this part

    def edges(self, flags: np.ndarray) -> None:
        """Find the edges whose minimizers are flagged: distinct keys in order, the first occurrence of each."""
        flagged = self.minimizers[flags]
        place = np.searchsorted(flagged, self.minimizer)
        place[place == len(flagged)] = 0
        self.at = self.starts[flagged[place] == self.minimizer] if len(flagged) else self.starts[:0]
        n = max(len(self.h) - self.window + 1, 0)
        key, more = (_polynomial(self.h, n, self.window, base)[self.at] for base in (MIX, MIX_2))
        more = (more >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(key, kind="stable")  # stable: the earliest document, then position, first
        same = key[order][1:] == key[order][:-1]
        if (more[order][1:][same] != more[order][:-1][same]).any():
            order = np.lexsort((more, key))
        key, more = key[order], more[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        self.keys, self.more = key[first], more[first]
        self.number = np.empty(len(order), dtype=np.int64)  # of each occurrence's key
        self.number[order] = np.cumsum(first) - 1
        source = self.at[order[first]]
        row = self.doc[source]
        self.source_doc = self.ids[row]
        self.source_at = row << ROW_SHIFT | source - self.begins[row]


def _bits(rows: pa.Table, kind: int, runs: list, length: int) -> tuple[np.ndarray, dict]:
    """The answered bits for sorted keys, and the rows by bucket."""
    found = {r["bucket"]: r for r in rows.to_pylist() if r["kind"] == kind}
    bits = np.zeros(length, dtype=bool)
    for b, begin, end in runs:
        if b in found:
            bits[begin:end] = np.unpackbits(np.frombuffer(found[b]["bits"], np.uint8), count=end - begin).astype(bool)
    return bits, found


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    fields = [f.split() for f in schema.split(", ")]
    return [n for n, _ in fields], [pa.int32() if t == "int" else pa.binary() for _, t in fields]


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    return _table(rows, *_types(schema))


def _ids_and_texts(docs: pa.Table) -> tuple[list, list]:
    return docs.column("__id").to_pylist(), docs.column("__text").to_pylist()


def _part_of(docs: pa.Table, window: int, minimizer: int) -> Part:
    return Part(*_ids_and_texts(docs), window, minimizer)


def _send_minimizers(docs: pa.Table, buckets: int, window: int, minimizer: int) -> pa.Table:
    part, number = _part_of(docs, window, minimizer), docs.column("__part")[0].as_py()
    return _rows([(b, number, _planes(part.minimizers[x:y]), None, None, None) for b, x, y in _runs(part.minimizers, buckets)], SENT)


def _answer_minimizers(sent: pa.Table) -> pa.Table:
    rows = sent.to_pylist()
    keys = [_from_planes(r["keys"], "u8") for r in rows]
    every = np.concatenate(keys)
    order = np.argsort(every)
    same = every[order][1:] == every[order][:-1]  # a part sends a key once, so equal keys are of several parts
    twice = np.zeros(len(every), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.cumsum([len(k) for k in keys])
    return _rows([(r["part"], 1, r["bucket"], np.packbits(twice[e - len(k) : e]).tobytes(), None, None, None) for r, k, e in zip(rows, keys, ends, strict=True)], ANSWER)


def _send_edges(docs: pa.Table, answers: pa.Table, buckets: int, window: int, minimizer: int) -> pa.Table:
    """Edges to their buckets; and, to be handed back with the answers, which minimizers are repeated."""
    if not len(docs):
        return _rows([], SENT)
    part, number = _part_of(docs, window, minimizer), docs.column("__part")[0].as_py()
    flags = _bits(answers, 1, _runs(part.minimizers, buckets), len(part.minimizers))[0] | part.shared
    part.edges(flags)
    out = [(b, number, _planes(part.keys[x:y]), _planes(part.more[x:y]), _planes(part.source_doc[x:y]), _planes(part.source_at[x:y])) for b, x, y in _runs(part.keys, buckets)]
    return _rows([(number % buckets, number, np.packbits(flags).tobytes(), None, None, None), *out], SENT)


def _answer_edges(sent: pa.Table) -> pa.Table:
    every = sent.to_pylist()
    out = [(r["part"], 1, -1, r["keys"], None, None, None) for r in every if r["doc"] is None]
    rows = [r for r in every if r["doc"] is not None]
    if not rows:
        return _rows(out, ANSWER)
    parts = [[_from_planes(r[c], t) for c, t in (("keys", "u8"), ("more", "u4"), ("doc", "i8"), ("at", "i8"))] for r in rows]
    keys, more, doc, at = (np.concatenate([p[k] for p in parts]) for k in range(4))
    home = np.repeat(np.array([r["part"] for r in rows], dtype=np.int32), [len(p[0]) for p in parts])
    source = np.arange(len(keys))
    order = np.argsort(keys)
    same = np.concatenate(([False], keys[order][1:] == keys[order][:-1]))
    several = order[same | np.append(same[1:], False)]  # only keys of several parts are put in full order
    several = several[np.lexsort((home[several], at[several], doc[several], more[several], keys[several]))]
    first = np.ones(len(several), dtype=bool)
    first[1:] = (keys[several][1:] != keys[several][:-1]) | (more[several][1:] != more[several][:-1])
    if len(several):
        source[several] = several[first][np.cumsum(first) - 1]
    later = doc[source] < doc
    begin = 0
    for r, p in zip(rows, parts, strict=True):
        end = begin + len(p[0])
        own = later[begin:end]
        if own.any():
            from_ = source[begin:end][own]
            out.append((r["part"], 2, r["bucket"], np.packbits(own).tobytes(), *(_planes(x[from_]) for x in (doc, at, home))))
        begin = end
    return _rows(out, ANSWER)


def _resolve(part: Part, number: int, answers: pa.Table, buckets: int) -> tuple[np.ndarray, ...]:
    """(place of each window that an earlier document has, its source document, place there, and part)."""
    flags = next(r["bits"] for r in answers.to_pylist() if r["kind"] == 1)
    part.edges(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(part.minimizers)).astype(bool))
    runs = _runs(part.keys, buckets)
    bits, found = _bits(answers, 2, runs, len(part.keys))
    doc, at, home = part.source_doc.copy(), part.source_at.copy(), np.full(len(part.keys), number, dtype=np.int32)
    for b, x, y in runs:
        if b in found:
            own = np.nonzero(bits[x:y])[0] + x
            for array, name, kind in ((doc, "source", "i8"), (at, "at", "i8"), (home, "home", "i4")):
                array[own] = _from_planes(found[b][name], kind)
    removed = doc[part.number] < part.ids[part.doc[part.at]]
    own = part.number[removed]
    return part.at[removed], doc[own], at[own], home[own]


def _compact(docs: pa.Table, answers: pa.Table, buckets: int, window: int, minimizer: int) -> pa.Table:
    """Nonbranching paths of the repeated edges: what is asked of the parts of their sources, and the part's own list."""
    if not len(docs):
        return _rows([], TOLD)
    part, number = _part_of(docs, window, minimizer), docs.column("__part")[0].as_py()
    places, source, at, home = _resolve(part, number, answers, buckets)
    new = np.ones(len(places), dtype=bool)
    new[1:] = (part.doc[places[1:]] != part.doc[places[:-1]]) | (places[1:] != places[:-1] + 1) | (home[1:] != home[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.nonzero(new)[0]
    words = np.diff(np.append(begin, len(places))) + window - 1
    first, source, at, home = places[begin], source[begin], at[begin], home[begin]
    row = part.doc[first]
    asked: dict[int, dict[tuple, int]] = {}
    place = np.empty(len(begin), dtype=np.int32)
    for j, (f, n, a, p) in enumerate(zip(first.tolist(), words.tolist(), at.tolist(), home.tolist(), strict=True)):
        key = (a, n, hashlib.blake2b(b" ".join(part.words[f : f + n]), digest_size=DIGEST).digest())
        of = asked.setdefault(p, {})
        place[j] = of.setdefault(key, len(of))
    out = [(number, number, 4, _planes(row), _planes(first - part.begins[row]), _planes(words), _planes(source), _planes(home), _planes(place), _planes(at))]
    for p, of in asked.items():
        keys = list(of)
        out.append((p, number, 3, None, _planes(np.array([k[0] for k in keys])), _planes(np.array([k[1] for k in keys])), None, None, None, b"".join(k[2] for k in keys)))
    return _rows(out, TOLD)


def _verify(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Which of the paths that are asked for have those words at those coordinates; a part's own list is handed on."""
    rows = told.to_pylist()
    out = [tuple(r[n] for n in _types(TOLD)[0]) for r in rows if r["kind"] == 4]
    ids, texts = _ids_and_texts(docs)
    order, split = _order(ids, texts), {}
    for r in rows:
        if r["kind"] != 3:
            continue
        agree = []
        for j, (place, n) in enumerate(zip(_from_planes(r["at"], "i8").tolist(), _from_planes(r["words"], "i8").tolist(), strict=True)):
            row, at = place >> ROW_SHIFT, place & (1 << ROW_SHIFT) - 1
            if row not in split:
                split[row] = (texts[order[row]] or "").encode().split()
            agree.append(hashlib.blake2b(b" ".join(split[row][at : at + n]), digest_size=DIGEST).digest() == r["more"][DIGEST * j : DIGEST * (j + 1)])
        out.append((r["part"], r["to"], 5, None, None, None, None, None, None, np.packbits(np.array(agree)).tobytes()))
    return _rows(out, TOLD)


def _verified(told: pa.Table) -> tuple[np.ndarray, ...]:
    """The verified paths of a part: (row, start, words, source document, place at the source)."""
    rows = told.to_pylist()
    own = next(r for r in rows if r["kind"] == 4)
    row, start, words, source, at = (_from_planes(own[c], "i8") for c in ("doc", "at", "words", "source", "more"))
    home, place = _from_planes(own["home"], "i4"), _from_planes(own["place"], "i4")
    good = np.zeros(len(row), dtype=bool)
    for r in rows:
        if r["kind"] == 5:
            asked = home == r["part"]
            good[asked] = np.unpackbits(np.frombuffer(r["more"], np.uint8)).astype(bool)[place[asked]]
    return tuple(x[good] for x in (row, start, words, source, at))


def _finish(docs: pa.Table, told: pa.Table, mode: str, names: list[str]) -> pa.Table:
    """The rows that are returned for one part; mode: digests, texts or paths."""
    if not len(docs):
        if mode == "paths":
            return pa.table({n: pa.array([], pa.int64()) for n in PATH_NAMES})
        empty = docs.select(names)
        for n, t in {"digests": {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}, "texts": {"kept_text": pa.string(), "n_removed": pa.int64()}}[mode].items():
            empty = empty.append_column(n, pa.array([], t))
        return empty
    row, start, words, source, at = _verified(told)
    ids, texts = _ids_and_texts(docs)
    order = _order(ids, texts)
    if mode == "paths":
        of = np.array([ids[order[r]] for r in row.tolist()], dtype=np.int64)
        return pa.table([pa.array(a) for a in (of, start, words, source, at & (1 << ROW_SHIFT) - 1)], names=PATH_NAMES)
    spans: dict[int, list[tuple[int, int]]] = {}
    for r, s, n in zip(row.tolist(), start.tolist(), words.tolist(), strict=True):
        spans.setdefault(order[r], []).append((s, n))
    words_of, removed_of, kept_of = [0] * len(docs), [0] * len(docs), [None] * len(docs)
    for k, text in enumerate(texts):
        own = (text or "").encode().split()
        gone = np.zeros(len(own) + 1, dtype=np.int64)
        for s, n in spans.get(k, ()):
            gone[s] += 1
            gone[s + n] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        words_of[k], removed_of[k] = len(own), int(gone.sum())
        if mode == "digests":
            kept_of[k] = hashlib.sha256(b" ".join(own if not removed_of[k] else [w for w, g in zip(own, gone.tolist(), strict=True) if not g])).hexdigest()
        else:
            kept_of[k] = text if not removed_of[k] else _without(text, gone)
    out = docs.select(names)
    if mode == "digests":
        return out.append_column("n_words", pa.array(words_of, pa.int64())).append_column("n_removed", pa.array(removed_of, pa.int64())).append_column("kept_sha256", pa.array(kept_of, pa.string()))
    return out.append_column("kept_text", pa.array(kept_of, pa.string())).append_column("n_removed", pa.array(removed_of, pa.int64()))


PATH_NAMES = ["doc_id", "start", "words", "source_doc_id", "source_start"]


def _without(text: str, gone: np.ndarray) -> str:
    """The text without its removed words: each keeps the white space before it, so the rest stays as it stands."""
    pieces, last = [], 0
    for m, g in zip(WORD_RE.finditer(text), gone.tolist(), strict=True):
        if not g:
            pieces.append(text[last : m.end()])
        last = m.end()
    pieces.append(text[last:])
    return "".join(pieces)


def sizes(total: int, partitions_: int) -> tuple[int, int]:
    """(parts, buckets) for so many bytes of text."""
    return max(PARTS_FOR_A_PARTITION * partitions_, -(-total // PART_BYTES)), max(partitions_, -(-total // BUCKET_BYTES))


def _run(docs: DataFrame, mode: str, window: int, minimizer: int, id_col: str, text_col: str) -> DataFrame:
    if not 1 < minimizer < window:
        raise ValueError("the minimizer is shorter than the window")
    id_, text = column(docs, id_col), column(docs, text_col)
    total = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0
    count, buckets = sizes(total, partitions(docs.sparkSession))
    part = F.pmod(F.xxhash64(id_, text), F.lit(count)).cast("int")
    names = [f"c{k}" for k in range(len(docs.columns))] if mode == "texts" else ["c0"] if mode == "digests" else []
    passed = [column(docs, c).alias(a) for a, c in zip(names, docs.columns if mode == "texts" else [id_col], strict=False)]
    parts = docs.select(part.alias("__part"), id_.cast("long").alias("__id"), text.alias("__text"), *passed)
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}

    def send_minimizers(docs: pa.Table) -> pa.Table:
        return _send_minimizers(docs, buckets, window, minimizer)

    def send_edges(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return _send_edges(docs, answers, buckets, window, minimizer)

    def compact(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return _compact(docs, answers, buckets, window, minimizer)

    def finish(docs: pa.Table, told: pa.Table) -> pa.Table:
        return _finish(docs, told, mode, names)

    by_part = parts.groupBy("__part")
    seen = by_part.applyInArrow(send_minimizers, SENT).groupBy("bucket").applyInArrow(_answer_minimizers, ANSWER)
    edges = by_part.cogroup(seen.groupBy("part")).applyInArrow(send_edges, SENT).groupBy("bucket").applyInArrow(_answer_edges, ANSWER)
    found = by_part.cogroup(edges.groupBy("part")).applyInArrow(compact, TOLD)
    agreed = by_part.cogroup(found.groupBy("to")).applyInArrow(_verify, TOLD)
    if mode == "paths":
        schema = ", ".join(f"{c} long" for c in PATH_NAMES)
    else:
        schema = ", ".join(f"{c} {kinds[c]}" for c in names) + (", n_words long, n_removed long, kept_sha256 string" if mode == "digests" else ", kept_text string, n_removed long")
    return by_part.cogroup(agreed.groupBy("to")).applyInArrow(finish, schema)


def digests(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256 of the kept words joined by one space)."""
    return _run(docs, "digests", window, minimizer, id_col, text_col).withColumnRenamed("c0", id_col)


def paths(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated spans: (doc_id, start, words, source_doc_id, source_start), word positions from 0."""
    return _run(docs, "paths", window, minimizer, id_col, text_col)


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with repeated words taken out of the text."""
    done = _run(docs, "texts", window, minimizer, id_col, text_col)
    return done.select(*(F.col("kept_text" if c == text_col else f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
