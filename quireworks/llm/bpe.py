"""Byte-level BPE encoding by a streaming transducer with bounded lookahead, and decoding by a byte-to-text state machine.

**Why tokens become stable.** A row of tokens is the BPE encoding of its bytes exactly if each adjacent pair is: joining
two neighbours and encoding the result gives the two back. So the encoding of any text, cut at one of its token boundaries q, is the
encoding of the first q bytes. No token is longer than L bytes, which the merge list gives (`Model.lookahead`); hence, whatever follows,
one of the last L positions is a boundary. The transducer keeps, for each position, the last token of the encoding up to there; tokens that the
encodings up to the last L positions have in common can't change any more and are emitted. Memory is that window, not the text.

Pre-tokens come from the public byte-level pattern; each is fed to the transducer and finished at its end. Texts are read in windows, cut at single spaces between two characters that
are no white space, where the pattern always ends a pre-token; a longer pre-token is fed in parts. What the transducer gave for a piece of text between two spaces is kept in a
bounded memo, an exact shortcut for pieces that come again. So beside the text itself, which Spark hands over whole, memory is bounded by the window and the memos.

The result equals the tokenizers library's with add_special_tokens=False: strings of added special tokens in a text are those tokens. Null text is encoded as
the empty text (0 tokens). Ids and null ids pass through; repeated rows are separate rows; other columns are ignored. A text of any
length is hashed in parts, and a pre-token of any length passes through the window.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, cut_at_spaces, give_back, text_of, windows, without_gc, worker_cache

#: Entries in each of the two generations of a worker's memo of pieces: about 200 bytes an entry.
MEMO = 400_000
#: Characters of a text that are looked up before the hashes are fed; of a pre-token that the transducer is fed at once, and that a memo is asked for.
WINDOW, LONG = 1 << 18, 1 << 12
#: Pairs of tokens of which it is known whether they stand; ids that are decoded at once.
PAIRS, PART = 500_000, 8192
# Fixed value: the public pre-token pattern of this family of vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte, as vocabulary files of this kind spell bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """What the transducer needs of a tokenizer file: the tokens' bytes, and each merge's rank and halves."""

    def __init__(self, file: bytes):
        data, alphabet = json.loads(file), byte_alphabet()
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        spelt = {w: bytes(alphabet[c] for c in w) for w in vocab if w not in self.special}
        self.ids = {spelt[w]: i for w, i in vocab.items() if w in spelt}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: w.encode() for w, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.birth: dict[int, tuple[int, int, int]] = {}
        for n, merge in enumerate(data["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = (vocab[left], vocab[right])
            self.rank[pair] = n
            self.birth.setdefault(vocab[left + right], (n, *pair))
        for token, (n, left, right) in sorted(self.birth.items(), key=lambda x: x[1][0]):
            # A token that its own bytes are not encoded as never comes out.
            if not (self.bytes_of[left] in self.ids and self.bytes_of[right] in self.ids and self._seam_holds(left, right, n)):
                del self.ids[self.bytes_of[token]]
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: The merge list's sufficient lookahead in bytes: the length of its longest token.
        self.lookahead = max(map(len, self.ids))
        #: Tokens as the vocabulary spells them, found in one walk over a text.
        self.automaton = ahocorasick.Automaton()
        for word, i in vocab.items():
            if spelt.get(word) in self.ids:
                self.automaton.add_word(word, (len(word), i))
        self.automaton.make_automaton()
        self.alphabet = {b: c for c, b in alphabet.items()}
        self.pairs: dict[int, bool] = {}

    def spell(self, data: bytes) -> str:
        """Bytes as the vocabulary writes them, a character each."""
        return data.decode("latin-1").translate(self.alphabet)

    def stands(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b together are encoded as a, b."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._seam_holds(a, b, len(self.rank))
        return known

    def _seam_holds(self, a: int, b: int, until: int) -> bool:
        """Whether no merge of a rank below `until` goes over the seam between tokens a and b."""
        # Back in time: undo the younger of the two tokens at the seam. A merge over the seam wins if it comes before
        # the merges that took its halves away; of equal ranks the leftmost comes first.
        taken_a = taken_b = until
        while True:
            over = self.rank.get((a, b), until)
            if over < taken_a and over <= taken_b:
                return False
            born_a, born_b = self.birth.get(a), self.birth.get(b)
            if born_a is None and born_b is None:
                return True
            if born_b is None or (born_a is not None and born_a[0] > born_b[0]):
                taken_a, a = born_a[0], born_a[2]
            else:
                taken_b, b = born_b[0], born_b[1]


class Transducer:
    """Encodes one pre-token: feed() its bytes in parts of any size, each call returning the tokens that have become stable, then finish().

    An automaton over all tokens names, at each position, the tokens that end there, longest first; one of them alone stands after the encoding up to its begin."""

    def __init__(self, model: Model):
        self.model = model
        self.search = model.automaton.iter("")
        self.base = 0  # position of steps[0]
        self.steps: list[tuple[int, int]] = [(0, -1)]  # for positions base, base + 1, ...: where the last token begins, its id

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        spelt = self.model.spell(data)
        most = self.model.lookahead
        for at in range(0, len(spelt), 4 * most):
            self._extend(spelt[at : at + 4 * most])
            if len(self.steps) > 2 * most:
                end = self.base + len(self.steps)
                out += self._emit(range(end - most, end))
        return out

    @property
    def window(self) -> list[tuple[int, int]]:
        """What is held of bytes whose tokens may still change."""
        return self.steps[1:]

    def finish(self) -> list[int]:
        out = self._emit([self.base + len(self.steps) - 1])
        self.search.set("", True)
        self.base, self.steps = 0, [(0, -1)]
        return out

    def _extend(self, spelt: str) -> None:
        base, steps, pairs, stands = self.base, self.steps, self.model.pairs, self.model.stands
        self.search.set(spelt)
        size = len(steps) + len(spelt)
        done = base + len(steps) - 1  # the last position that has its token
        for last, (length, token) in self.search:
            if last < done:
                continue
            begin = last + 1 - length
            if begin < base:
                continue
            before = steps[begin - base][1]
            if before < 0 or (pairs[key] if (key := before << 32 | token) in pairs else stands(before, token)):
                steps.append((begin, token))
                done = last + 1
        if len(steps) != size:
            raise ValueError("a byte is missing from the vocabulary")

    def _emit(self, live) -> list[int]:
        """The tokens up to the last boundary that the encodings of all live positions share; the window is cut there."""
        base, steps = self.base, self.steps
        heap = [-p for p in set(live)]
        heapq.heapify(heap)
        while len(heap) > 1:
            last = -heapq.heappop(heap)
            if last == base:
                break
            before = -steps[last - base][0]
            if before not in heap:
                heapq.heappush(heap, before)
        at = cut = -heap[0] if heap else base
        out = []
        while at > base:
            at, token = steps[at - base]
            out.append(token)
        if cut > base:
            # A boundary that is known to hold: what comes before it is still compared with the next token.
            self.steps = [(cut, steps[cut - base][1]), *steps[cut - base + 1 :]]
            self.base = cut
        return out[::-1]


class Table:
    """Byte strings by number; gathers those of many numbers at once."""

    def __init__(self, values: dict[int, bytes]):
        self.size = np.zeros(max(values) + 1, np.int64)
        for i, v in values.items():
            self.size[i] = len(v)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(values.get(i, b"") for i in range(len(self.size))), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[ids] - ends + size, size)].tobytes()


class Encoder:
    """Texts -> their ids as little-endian u32, in parts. Every pre-token goes through the transducer once; a memo of what it gave for pieces of text between spaces (without the space
    before them) is an exact shortcut for those that come again, and a small one serves pre-tokens that have no space before them."""

    def __init__(self, file: bytes, memo: int = MEMO):
        self.model = Model(file)
        self.transducer = Transducer(self.model)
        self.names = Table({i: b"%d," % i for i in self.model.bytes_of})
        self.spelling = Table(self.model.bytes_of)
        self.words = Memo(self._word, memo // 8)
        self.memo = Memo(lambda piece: self.ids(" " + piece), memo)

    def _word(self, text: str) -> bytes:
        """One pre-token."""
        ids = self.transducer.feed(text.encode("utf-8", "surrogatepass"))
        ids += self.transducer.finish()
        return struct.pack(f"<{len(ids)}I", *ids)

    def _known(self, word: str) -> bytes:
        return self.memo[word[1:]] if word[0] == " " and not word.isspace() else self.words[word]

    def ids(self, text: str) -> bytes:
        """A text in one."""
        if not self._special(text):
            found = PATTERN.findall(text) if len(text) <= LONG else []
            if len(found) == 1 and text[0] == " ":
                return self._word(text)
            if found:
                return b"".join(map(self._known, found))
        return b"".join(self.stream(text))

    def _special(self, text: str) -> bool:
        return any(name in text for name in self.model.special)

    def stream(self, text: str) -> Iterator[bytes]:
        """A text pre-token by pre-token. One of more than LONG characters is fed in parts, and its tokens come out as they become stable."""
        model, machine, at = self.model, self.transducer, 0
        marks = model.special_re.finditer(text) if model.special_re else ()
        for mark in [*marks, None] if len(text) <= LONG else itertools.chain(marks, [None]):
            for m in PATTERN.finditer(text, at, mark.start() if mark else len(text)):
                begin, end = m.span()
                if end - begin <= LONG:
                    yield self._known(m[0])
                    continue
                for i in range(begin, end, LONG):
                    ids = machine.feed(text[i : min(i + LONG, end)].encode("utf-8", "surrogatepass"))
                    yield struct.pack(f"<{len(ids)}I", *ids)
                ids = machine.finish()
                yield struct.pack(f"<{len(ids)}I", *ids)
            if mark:
                yield struct.pack("<I", model.special[mark[0]])
                at = mark.end()

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The text's ids, in arrays: of each window its first piece, then the others."""
        if not text:
            return
        memo = self.memo
        for window in windows(text, WINDOW):
            cut = cut_at_spaces(window)
            for at, piece in enumerate(cut):
                if len(piece) > LONG:  # no memo for it, and no bound on its ids
                    break
            else:
                first = self.ids(cut[0]) if cut[0] else b""
                yield np.frombuffer(b"".join([first, *map(memo.__getitem__, cut[1:])]), "<u4")
                continue
            for at, piece in enumerate(cut):
                for ids in self.stream(f" {piece}" if at else piece):
                    yield np.frombuffer(ids, "<u4")


def encode_text(encoder: Encoder, text: str) -> list[int]:
    return [i for part in encoder.parts(text) for i in part.tolist()]


class Decoder:
    """Ids -> text, fed in parts: the state is the bytes of a character that is not complete. What is not UTF-8 becomes U+FFFD."""

    def __init__(self, spelling: Table):
        self.spelling, self.machine = spelling, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(self.spelling(np.asarray(ids, np.int64)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def _file(docs: DataFrame, path: str):
    """The tokenizer file, read by the driver and sent out: its size is fixed (about 2 MB), and executors may not have it."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encoder_of(broadcast, memo: int = MEMO) -> Encoder:
    """One encoder for each worker process and file; its memos live on over tasks."""
    file = broadcast.value
    return worker_cache(("bpe", hash(file), memo), lambda: Encoder(file, memo))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for each row of docs (doc_id, text)."""
    file = _file(docs, path)
    schema = docs.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches):
        encoder = encoder_of(file)
        for batch in batches:
            ids, texts = [], []
            for text in batch.column(1).to_pylist():
                ids.append(encode_text(encoder, text))
                decoder = Decoder(encoder.spelling)
                texts.append("".join([*(decoder.feed(ids[-1][i : i + PART]) for i in range(0, len(ids[-1]), PART)), decoder.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, memo: int = MEMO) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text). memo bounds the worker's memory: fewer pieces cost time only."""
    file = _file(docs, path)
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        encoder = encoder_of(file, memo)
        for batch in without_gc(batches):
            rows = [digests(encoder, text.as_py()) for text in batch.column(1)]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def digests(encoder: Encoder, text: str) -> tuple[int, str, str]:
    n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(encoder.spelling)
    for ids in encoder.parts(text):
        if len(ids):
            of_ids.update((b"," if n else b"") + encoder.names(ids)[:-1])
        n += len(ids)
        of_text.update(decoder.feed(ids).encode())
    of_text.update(decoder.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()
