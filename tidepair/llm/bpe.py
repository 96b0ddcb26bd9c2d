"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

A token sequence is what the merges would give exactly if every token encodes to itself and
every neighbouring pair encodes to itself. So the merges become a transducer: a hypothesis
is (last token, place in the token trie, tokens not yet emitted); it ends a token where the
pair with the last one is valid. The subset of live hypotheses is a state; the tokens that
all of them agree on are emitted, so output lags by a bounded number of bytes. States and
moves are made when a text first needs them and kept for the next.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.llm import text as tx

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Moves, states and pieces kept by a process; beyond, they are dropped and made anew.
MOST_KEPT = 500_000
#: Characters of a text that are split at once.
CHUNK_CHARS = 1_000_000
_REPLACEMENT = "�".encode()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Bytes to token ids. ``step`` moves by one byte, ``finish`` gives what is still held back."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # The trie: one dict of children a node, and the token that ends there.
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.ends[node] = rank
        self.alone: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all determinised states; state 0 is the start."""
        self.states = [((-1, 0, ()),)]
        self.names = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple]] = {}

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """The merges carried out on the bytes of one token, until so many parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte."""
        known = self.halves.get(token)
        if known is None and len(self.tokens[token]) > 1:
            known = self.halves[token] = tuple(self.merged(self.tokens[token], 2))
        return known

    def parted(self, last: int, token: int) -> bool:
        """Whether the merges leave the border between two tokens alone.

        Backwards in time, the token at the border that was merged later is taken apart, until
        both are bytes. At each moment the pair at the border must not merge sooner than the
        next merge on either side; of equal ranks the left one comes first.
        """
        left_until = right_until = len(self.tokens) + 1
        while True:
            rank = self.ranks.get(self.tokens[last] + self.tokens[token])
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            left, right = self.split(last), self.split(token)
            if left is None and right is None:
                return True
            if right is None or (left is not None and last > token):
                left_until, last = last, left[1]
            else:
                right_until, token = token, right[0]

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last`` (-1: at the start)."""
        fine = self.alone.get(token)
        if fine is None:
            fine = self.alone[token] = self.merged(self.tokens[token]) == [token]
        if last < 0 or not fine:
            return fine
        known = self.pairs.get((last, token))
        if known is None:
            if len(self.pairs) > MOST_KEPT:
                self.pairs.clear()
            known = self.pairs[last, token] = self.parted(last, token)
        return known

    def move(self, state: int, byte: int) -> tuple[int, tuple]:
        """Makes the move from a state: the next state and the tokens that are now certain."""
        live, done = [], None
        children, ends = self.children, self.ends
        for last, node, pending in self.states[state]:
            child = children[node].get(byte)
            if child is None:
                continue
            # One hypothesis ends a token at each byte; the longest token is tried first.
            if done is None and ends[child] >= 0 and self.follows(last, ends[child]):
                done = (ends[child], 0, (*pending, ends[child]))
            if children[child]:
                live.append((last, child, pending))
        live.append(done)
        # Hypotheses stay in the order of their beginnings, so the last one holds most tokens.
        first, shared = done[2], min([len(h[2]) for h in live])
        for _, _, p in live:
            while p[:shared] != first[:shared]:
                shared -= 1
        held = tuple([(last, node, p[shared:]) for last, node, p in live]) if shared else tuple(live)
        name = self.names.get(held)
        if name is None:
            name = self.names[held] = len(self.states)
            self.states.append(held)
        self.moves[state << 8 | byte] = name, first[:shared]
        return name, first[:shared]

    def finish(self, state: int) -> tuple:
        """Tokens held back in a state, if the bytes end here."""
        return next((p for _, node, p in self.states[state] if node == 0), ())

    def encode(self, data: bytes) -> tuple:
        """Ids of one piece. A piece that is a token as a whole is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(self.moves) > MOST_KEPT or len(self.states) > MOST_KEPT:
            self.reset()
        moves, state, out = self.moves, 0, []
        for b in data:
            known = moves.get(state << 8 | b)
            state, sure = known if known is not None else self.move(state, b)
            if sure:
                out += sure
        return (*out, *self.finish(state))


class Encoder:
    """Texts to ids: each match of the pattern runs through the transducer on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.gap = regex.compile(r"(?<=\S)(?=\s)")
        self.kept: dict[str, tuple[tuple, str]] = {}

    def pieces(self, text: str):
        """Lists of pieces of a text, chunk by chunk: a blank after a non-blank begins a piece."""
        at = 0
        while at < len(text):
            cut = self.gap.search(text, at + CHUNK_CHARS) if len(text) - at > CHUNK_CHARS else None
            end = cut.start() if cut else len(text)
            yield self.pattern.findall(text[at:end])
            at = end

    def encode(self, text: str) -> tuple[list[int], list[str]]:
        """Ids, and the same as decimal strings by piece."""
        ids, written = [], []
        kept = self.kept
        for pieces in self.pieces(text):
            for missing in set(pieces).difference(kept):
                if len(kept) >= MOST_KEPT:
                    kept.clear()
                    break
                got = self.transducer.encode(missing.encode())
                kept[missing] = got, ",".join(map(str, got))
            try:
                found = [kept[p] for p in pieces]
            except KeyError:  # the store was cleared on the way
                found = [(got, ",".join(map(str, got))) for got in (self.transducer.encode(p.encode()) for p in pieces)]
            ids.extend(chain.from_iterable(f[0] for f in found))
            written.extend(f[1] for f in found)
        return ids, written


class Utf8Machine:
    """Which bytes may follow: states are (bytes still to come, least and greatest next byte)."""

    START, BAD = 0, -1

    def __init__(self):
        names = {(0, 0, 0): 0}
        self.rows: list[list[int]] = []
        todo = [(0, 0, 0)]
        while todo:
            left, low, high = todo.pop(0)
            row = [self.BAD] * 256
            for b in range(256):
                nxt = self.first(b) if left == 0 else ((left - 1, 0x80, 0xBF) if left > 1 else (0, 0, 0)) if low <= b <= high else None
                if nxt is not None:
                    if nxt not in names:
                        names[nxt] = len(names)
                        todo.append(nxt)
                    row[b] = names[nxt]
            self.rows.append(row)

    @staticmethod
    def first(b: int):
        """State after a first byte: how many follow, and which range the next one has."""
        if b < 0x80:
            return 0, 0, 0
        if 0xC2 <= b <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= b <= 0xEF:
            return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        if 0xF0 <= b <= 0xF4:
            return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        return None

    def run(self, state: int, data: bytes) -> int:
        for b in data:
            state = self.rows[state][b]
            if state < 0:
                break
        return state


class Decoder:
    """Ids to UTF-8, as a stream: bytes go out as soon as their character is complete.

    The state after a token is a table entry, filled when first needed. Bytes that can't
    become a character come out as U+FFFD.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        self.machine = Utf8Machine()
        self.after = [{} for _ in self.machine.rows]
        self.clear()

    def clear(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, ids: list[int]) -> bytes:
        """Complete characters of the held bytes and ``ids``; the rest is held back."""
        tokens, after, state = self.tokens, self.after, self.state
        for t in ids:
            nxt = after[state].get(t)
            if nxt is None:
                nxt = after[state][t] = self.machine.run(state, tokens[t])
            state = nxt
            if state < 0:
                break
        data = self.held + b"".join([tokens[t] for t in ids])
        if state < 0:
            return self.repair(data)
        self.state = state
        whole = len(data)
        while state and whole:
            whole -= 1
            if data[whole] & 0xC0 != 0x80:
                break
        self.held = data[whole:] if state else b""
        return data[:whole] if state else data

    def repair(self, data: bytes) -> bytes:
        """The same byte by byte, when some byte has no place."""
        rows, out, begin, state, i = self.machine.rows, bytearray(), 0, 0, 0
        while i < len(data):
            nxt = rows[state][data[i]]
            if nxt < 0:
                out += _REPLACEMENT
                i += state == 0
                begin, state = i, 0
                continue
            i += 1
            state = nxt
            if state == 0:
                out += data[begin:i]
                begin = i
        self.state, self.held = state, data[begin:]
        return bytes(out)

    def finish(self) -> bytes:
        """What is left at the end: a character that never became complete."""
        rest = _REPLACEMENT if self.held else b""
        self.clear()
        return rest


_made: dict[str, tuple[Encoder, Decoder]] = {}


def tokenizer(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a rank file, made once a process."""
    if path not in _made:
        ranks = load_ranks(path)
        encoder = Encoder(ranks, pattern)
        _made[path] = encoder, Decoder(encoder.transducer.tokens)
    return _made[path]


def _decoded(decoder: Decoder, ids: list[int], chunk: int = 4096) -> bytes:
    decoder.clear()
    parts = [decoder.feed(ids[i : i + chunk]) for i in range(0, len(ids), chunk)]
    return b"".join(parts) + decoder.finish()


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = True) -> DataFrame:
    """Ids of every text, with a round trip: (doc_id, n_tokens, ids, ids_sha256, decoded_sha256, exact).

    A null text counts as empty: no ids. ``exact`` tells that decoding gave the text's bytes.
    ``keep_ids`` False leaves the id lists out. Repeated rows get the same ids; an empty table
    gives an empty result.
    """
    path = path or public_tokenizers.path(RANKS)

    def fn(batch, texts):
        encoder, decoder = tokenizer(path, pattern)
        lists, counts, digests, decoded, exact = [], [], [], [], []
        for data in texts:
            ids, written = encoder.encode(data.decode())
            back = _decoded(decoder, ids)
            if keep_ids:
                lists.append(np.asarray(ids, dtype=np.int32))
            counts.append(len(ids))
            digests.append(hashlib.sha256(",".join(written).encode()).hexdigest())
            decoded.append(hashlib.sha256(back).hexdigest())
            exact.append(back == data)
        out = [batch.column("doc_id"), counts]
        if keep_ids:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))))
        return *out, digests, decoded, exact

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = "ids array<int>, " if keep_ids else ""
    return tx.map_texts(rows, fn, f"doc_id {kind}, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string, exact boolean")


def decode(rows: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, text) of rows with ``ids``; a null list gives an empty text, a null id nothing."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        _, decoder = tokenizer(path, pattern)
        for batch in batches:
            texts = [_decoded(decoder, [i for i in ids or () if i is not None]).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
