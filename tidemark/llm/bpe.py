"""Byte-level BPE encoding and decoding with a lazily determinised finite-state transducer.

The tokens of a vocabulary form a trie over bytes. Of each prefix of a piece exactly one token can be the last
of its encoding: the one that ends there and is compatible with the last token of the prefix it starts from
(two tokens are compatible if the merges, applied to their bytes joined, give back these two). A state of the
transducer holds the starts from which a token may still grow, each with its trie node and the tokens that lead
to it and aren't settled. What all these have in common is settled and emitted, so a token is emitted after a
lookahead of at most the longest token. States and transitions are made when first needed. When there are
MAX_TRANSITIONS, a piece that needs another runs through the undeterminised transducer, depth first, longest token first
(each end of a token is entered once: the last token of a prefix is unique); after MAX_MISSES such pieces a worker drops
all states and determinises anew for what it meets then. So its memory is bounded whatever the texts hold.
A piece that is itself in the vocabulary is that one token, as in the public encoders. Decoding feeds the tokens'
bytes through an incremental UTF-8 state machine.

Defined cases: a null text is an empty text and has no tokens; repeated rows are encoded each; an empty table
gives no rows; extra columns are ignored; special tokens' strings are ordinary text. Ids that form no valid
UTF-8 decode with U+FFFD, as the state machine finds them.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import python_batches, table

#: Most transitions, pieces that then do without before all are dropped, token pairs before they are, and pieces remembered (the first met).
MAX_TRANSITIONS = 50_000
MAX_MISSES = 200_000
MAX_PAIRS = 300_000
MAX_PIECES = 300_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encoder of single pieces; `encode_text` splits a text into pieces by the pattern first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        # The trie: (node << 8 | byte) to child, the token that ends at a node (-1: none), and whether tokens go on from it. The root is node 0.
        self.children: dict[int, int] = {}
        self.token_at, self.goes_on = array("i", [-1]), bytearray(1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            node = 0
            for byte in token:
                child = self.children.get(node << 8 | byte)
                if child is None:
                    child = self.children[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.goes_on.append(0)
                    self.goes_on[node] = 1
                node = child
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.start_afresh()

    def start_afresh(self) -> None:
        """Only the start state, number 0, and no transitions."""
        start = (None, ((0, ()),))
        self.states: list[tuple] = [start]
        self.numbers: dict[tuple, int] = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.misses = 0

    def reachable(self, token: int) -> bool:
        """Whether merges make the token from its bytes."""
        known = self.made.get(token)
        if known is None:
            known = self.made[token] = len(self.bytes_of[token]) == 1 or self.halves(token)[0] != token
        return known

    def merges(self, piece: bytes, below: int = 1 << 62) -> list[int]:
        """The encoding by definition: merge the leftmost pair of lowest rank, if that is less than below, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and rank < below and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a single byte, or what no merges make, is both of its own."""
        known = self.parts.get(token)
        if known is None:
            joined = self.bytes_of[token]
            parts = self.merges(joined, below=token) if len(joined) > 1 else [token]
            known = self.parts[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return known

    def compatible(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges that made the two tokens.

        The tokens are taken apart from the border outwards, the younger one first; a pair at the border that is
        a token older than the part last undone would have been merged.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        a, b, limit, of, ranks = left, right, 1 << 62, self.bytes_of, self.ranks
        while True:
            merged = ranks.get(of[a] + of[b])
            if merged is not None and merged < limit and self.halves(merged) == (a, b):
                known = False
                break
            if a > b:
                undone, a = a, self.halves(a)[1]
                limit = undone
                if a == undone:
                    undone, b = b, self.halves(b)[0]
                    limit = undone + 1
                    if b == undone:
                        known = True
                        break
            else:
                undone, b = b, self.halves(b)[0]
                limit = undone + 1
                if b == undone:
                    undone, a = a, self.halves(a)[1]
                    limit = undone
                    if a == undone:
                        known = True
                        break
        self.pairs[key] = known
        return known

    def move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one more byte, and the tokens settled by it."""
        last, live = self.states[number]
        children, goes_on = self.children.get, self.goes_on
        grown, found = [], None
        for node, chain in live:
            child = children(node << 8 | byte)
            if child is None:
                continue
            if found is None and (token := self.token_at[child]) >= 0 and self.reachable(token):
                before = chain[-1] if chain else last
                if before is None or self.compatible(before, token):
                    found = (*chain, token)
            if goes_on[child]:
                grown.append((child, chain))
        if found is None:
            raise ValueError("the vocabulary lacks single bytes")
        settled = len(found)
        for _, chain in grown:
            n = 0
            for x, y in zip(chain, found):
                if x != y:
                    break
                n += 1
            settled = min(settled, n)
        out = found[:settled]
        grown.append((0, found))
        state = (out[-1] if out else last, tuple((node, chain[settled:]) for node, chain in grown))
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.moves[number << 8 | byte] = (target, out)
        return target, out

    def depth_first(self, piece: bytes, settled: list[int]) -> list[int]:
        """All tokens, from the settled ones on, without determinised states: longest token first, back where no compatible one is left."""
        compatible, reachable, children, token_at, of = self.compatible, self.reachable, self.children.get, self.token_at, self.bytes_of
        size, tokens, ways, ends, dead = len(piece), settled, [], [sum(len(of[t]) for t in settled)], set()
        while True:
            at = ends[-1]
            if at == size:
                return tokens
            if len(ways) < len(ends):
                found, node, i = [], 0, at
                while i < size and (node := children(node << 8 | piece[i])) is not None:
                    i += 1
                    if (token := token_at[node]) >= 0:
                        found.append((token, i))
                ways.append(found)
            options = ways[-1]
            while options:
                token, end = options.pop()
                if end not in dead and (compatible(tokens[-1], token) if tokens else True) and reachable(token):
                    tokens.append(token)
                    ends.append(end)
                    break
            else:
                if len(ends) == 1:
                    raise ValueError("the vocabulary lacks single bytes")
                dead.add(at)
                tokens.pop()
                ends.pop()
                ways.pop()

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if self.misses >= MAX_MISSES:
            self.start_afresh()
        tokens: list[int] = []
        state, get = 0, self.moves.get
        for byte in piece:
            step = get(state << 8 | byte)
            if step is None:
                if len(self.moves) >= MAX_TRANSITIONS:
                    self.misses += 1
                    return tuple(self.depth_first(piece, tokens))
                step = self.move(state, byte)
            state = step[0]
            if step[1]:
                tokens += step[1]
        return (*tokens, *self.states[state][1][-1][1])

    def encode_text(self, text: str) -> array:
        ids, known = array("I"), self.pieces
        for piece in self.split(text):
            tokens = known.get(piece)
            if tokens is None:
                tokens = self.encode_piece(piece.encode())
                if len(known) < MAX_PIECES and len(piece) <= 32:
                    known[piece] = tokens
            ids.extend(tokens)
        return ids

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Text of the ids, chunk by chunk; bytes of a character that isn't complete wait in the state machine."""
        machine, of, held = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of, []
        for i in ids:
            held.append(of[i])
            if len(held) == chunk:
                yield machine.decode(b"".join(held))
                held.clear()
        yield machine.decode(b"".join(held), True)


def little_endian(ids: array) -> bytes:
    import sys

    if ids.itemsize != 4:
        raise ValueError("ids need 32 bits")
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


_made: dict[int, Transducer] = {}


def _transducer(data: bytes, pattern: str) -> Transducer:
    key = hash((data, pattern))
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(read_ranks(data), pattern)
    return _made[key]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit; null unless with_ids), ids_sha256, decoded_sha256, decoded_chars."""
    spark: SparkSession = docs.sparkSession
    python_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path, pattern))  # a vocabulary file: its size is fixed

    def work(batches):
        import pyarrow as pa

        coder = _transducer(*shared.value)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = coder.encode_text(text.as_py() or "")
                packed = little_endian(ids)
                digest, chars = hashlib.sha256(), 0
                for piece in coder.decode_stream(ids):
                    digest.update(piece.encode())
                    chars += len(piece)
                for column, value in zip(out, (doc.as_py(), len(ids), packed if with_ids else None, hashlib.sha256(packed).hexdigest(), digest.hexdigest(), chars), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64()), strict=True)],
                names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded_chars"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string, decoded_chars long")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (as `encode` gives them; null ids: null text)."""
    spark: SparkSession = rows.sparkSession
    python_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def work(batches):
        import pyarrow as pa

        coder = _transducer(*shared.value)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                texts.append(None if ids is None else "".join(coder.decode_stream(memoryview(ids).cast("I") if ids else ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
