"""SentencePiece encoding and decoding by tables of distinct chunks.

Where no piece of the vocabulary holds a whitespace marker after another character and texts aren't normalised, a text's
pieces never cross from a non-space into a space. So texts are cut there into chunks (spaces and the word after them);
each task looks its chunks up by an exact-case 64-bit hash in a table, lets the library segment a chunk it hasn't seen,
and joins the ids back by position with array operations. Decoding joins the chunks' decoded texts the same way. Texts
with a literal U+2581, which the library reads as a space, and all texts under other vocabularies, go through the library
whole. The table is emptied when it holds TABLE chunks or IDS ids, so it never holds more than these and what one
slice of SLICE bytes (or one longer text) adds; what it returns doesn't depend on it.

A null text counts as empty: begin and end ids only, decoded to an empty text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.llm import bytewords as bw

SLICE, TABLE, IDS = 1 << 20, 400_000, 4_000_000
MARK = "▁"
ODD = MARK.encode()


class Chunks:
    """The library's model and the table of chunks seen so far in this task."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        probe = "  aéﬁＡ  b \t\n c  "
        self.fit = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.decode(self.sp.encode(probe)) == probe
        self.mark = self.sp.piece_to_id(MARK)
        self.guard = self.sp.encode("a")[-1:]
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at, self.same = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each chunk's row in the table; unseen ones are segmented first. Chunks begin with a space."""
        h = bw.hashes(raw, starts, ends, bw.EXACT)
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        fresh = np.flatnonzero(self.keys[at] != key) if len(self.keys) else np.arange(len(key))
        if len(fresh):
            data = raw.tobytes()
            words = [data[a + 1 : b].decode() for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())]
            ids = [x if w else [self.mark] for x, w in zip(self.sp.encode(words, num_threads=1), words)]
            said = self.sp.decode([self.guard + x for x in ids], num_threads=1)
            same = [s == f"a {w}" for s, w in zip(said, words)]
            slots = len(self.same) + np.arange(len(fresh))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32)])
            self.at = np.r_[self.at, self.at[-1] + np.cumsum([len(x) for x in ids])]
            self.same = np.r_[self.same, same]
            keys = np.r_[self.keys, key[fresh]]
            order = np.argsort(keys, kind="stable")
            self.keys, self.slots = keys[order], np.r_[self.slots, slots][order]
            at = np.searchsorted(self.keys, key)
        return self.slots[at][back]


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space put before each, and their offsets."""
    n = len(offsets) - 1
    line = np.full(len(raw) + n, 32, np.uint8)
    line[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
    return line, offsets + np.arange(n + 1)


def encode_pieces(docs: DataFrame, model: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs' other columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids, of every whole text."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    keep = [c for c in docs.columns if c != text and c not in made]
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *fields])

    def run(batches):
        table = Chunks(model)
        sp = table.sp
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def whole(data: bytes) -> tuple[np.ndarray, str]:
            ids = [sp.bos_id(), *sp.encode(data.decode()), sp.eos_id()]
            return np.array(ids, "<u4"), sha(sp.decode(ids).encode())

        def made_of(part, ids, said):
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.tobytes()) for x in ids], pa.string()), pa.array(said, pa.string())]
            if with_ids:
                at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32))))
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=schema.names)

        for batch in batches:
            raw, offsets = bw.text_bytes(batch.column("__text"))
            for lo, hi in bw.slices(offsets, SLICE):
                out_ids, out_text = [], []
                part = raw[offsets[lo] : offsets[hi]]
                at = offsets[lo : hi + 1] - offsets[lo]
                data = part.tobytes()
                if not table.fit:
                    both = [whole(data[a:b]) for a, b in zip(at[:-1], at[1:])]
                    out_ids += [x for x, _ in both]
                    out_text += [x for _, x in both]
                    yield made_of(batch.slice(lo, hi - lo), out_ids, out_text)
                    continue
                if len(table.same) > TABLE or len(table.ids) > IDS:
                    table.clear()
                line, begin = spaced(part, at)
                space = line == 32
                cut = space.copy()
                cut[1:] &= ~space[:-1]
                cut[begin[:-1]] = True
                starts = np.flatnonzero(cut)
                ends = np.r_[starts[1:], len(line)]
                slot = table.look_up(line, starts, ends)
                count = table.at[slot + 1] - table.at[slot]
                place = np.r_[0, np.cumsum(count)]
                flat = table.ids[np.repeat(table.at[slot] - place[:-1], count) + np.arange(place[-1])]
                chunk = np.searchsorted(starts, begin)
                plain = np.add.reduceat(~table.same[slot], chunk[:-1]) == 0
                odd = ODD in data
                for r in range(hi - lo):
                    own = data[at[r] : at[r + 1]]
                    if not own:
                        out_ids.append(np.array([sp.bos_id(), sp.eos_id()], "<u4"))
                        out_text.append(sha(b""))
                    elif odd and ODD in own:
                        ids, said = whole(own)
                        out_ids.append(ids)
                        out_text.append(said)
                    else:
                        ids = np.r_[sp.bos_id(), flat[place[chunk[r]] : place[chunk[r + 1]]], sp.eos_id()].astype("<u4")
                        out_ids.append(ids)
                        # every chunk decodes to itself, so the text does
                        out_text.append(sha(own) if plain[r] else sha(sp.decode(ids.tolist()).encode()))
                yield made_of(batch.slice(lo, hi - lo), out_ids, out_text)

    return rows.mapInArrow(run, schema)
