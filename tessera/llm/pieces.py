"""SentencePiece encoding by streaming Viterbi, and decoding.

A text (spaces as U+2581, one put in front) is cut into the pieces of a model
with the greatest sum of scores. A unigram model's scores are taken as they are.
A merge model only ranks its pieces; its scores become log-probabilities by
Zipf's law, -log((rank + 2) * H), so its ids are those of the best cut, not of
the merges. Characters no piece covers become byte pieces, ten nats below the
least score each; ties go to the longer last piece.

There is one search, ``Encoder.stream``. It keeps a window: the scores of as many
places as the longest piece has characters, and back-pointers since the last
commit. Whenever all paths that still can be extended go back through one
boundary, the ids before it are final and are given out: at once where no piece
reaches beyond a place, else where the back-pointers of the window meet. Between
two places that no piece can span, the search neither sees nor gives anything
that depends on the rest, so what it gave for such a stretch (a word, for common
models) is remembered and not searched again.

Decoding joins the pieces' bytes. It gives the text back exactly: a U+2581 of
the text itself is encoded as bytes. Null text counts as empty and has no ids.
Rows are encoded one by one; other columns pass through, those called like the
results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, extended, lean

SPACE = "▁"
#: At a space that follows another character, as far as no piece spans such a place.
WORDS = re.compile(" *[^ ]+| +")
NONE = float("-inf")
#: Characters of a text that the search is given at once.
FEED = 256
#: Stands for a U+2581 of the text, which is no space: the first of these that the text lacks (no piece has them).
STAND_INS = (range(0xFDD0, 0xFDF0), range(0xF0000, 0xFFFFE))


class Model:
    """Pieces with scores, from a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        n = range(p.get_piece_size())
        plain = [i for i in n if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        scores = {i: p.get_score(i) for i in plain}
        if all(float(s).is_integer() for s in scores.values()):  # ranks of merges
            order = sorted(plain, key=lambda i: (-scores[i], i))
            total = float(np.sum(1 / np.arange(2, len(order) + 2)))
            scores = {i: -float(np.log((rank + 2) * total)) for rank, i in enumerate(order)}
        self.ids = {p.id_to_piece(i): (scores[i], i) for i in plain}
        self.number = {piece: i for piece, (_, i) in self.ids.items()}
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in n if p.is_byte(i)}
        self.unknown = p.unk_id()
        self.penalty = min(scores.values()) - 10
        self.longest = max(map(len, self.ids))
        #: The pieces as a tree: by character, what may follow, and the score if a piece ends here.
        self.tree: dict[str, list] = {}
        for piece, (score, _) in self.ids.items():
            entry, below = None, self.tree
            for c in piece:
                entry = below.setdefault(c, [{}, None])
                below = entry[0]
            entry[1] = score
        self.pairs = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.words = not any(a != SPACE and b == SPACE for a, b in (x for x in self.pairs))
        self.text_of = {i: piece.replace(SPACE, " ").encode() for piece, (_, i) in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}


class Encoder(Remembered):
    """Packed ids of texts; those of stretches that no piece leaves are remembered.

    Stretches are keys with plain spaces, so most take a byte a character, and a
    generation has as many as a dictionary of 2**18 places holds.
    """

    def __init__(self, model: Model):
        super().__init__((1 << 18) * 2 // 3)
        self.model = model

    def stream(self, chars, own: str | None = None):
        """Lists of ids of an iterable of strings, given out as soon as they are final.

        ``own``: the character that stands for a U+2581 of the text.
        """
        tree, window, penalty, none = self.model.tree, self.model.longest, self.model.penalty, NONE
        text, score, back = "", [0.0], [0]  # since the last commit; scores and back-pointers by place
        j = reach = checked = 0  # the place that pieces start from, and how far pieces before it reach
        parts, ended = iter(chars), False
        while not ended:
            part = next(parts, None)
            if part is None:
                ended, stop = True, len(text)
            else:
                text += part
                score += [none] * len(part)
                back += [0] * len(part)
                stop = len(text) - window
            n = len(text)
            while j < stop:
                here, k, below = score[j], j, tree
                while k < n and (entry := below.get(text[k])):  # else no piece starts like this
                    below, gain = entry
                    k += 1
                    if gain is not None:
                        gain += here
                        if gain > score[k]:
                            score[k], back[k] = gain, j
                        if k > reach:
                            reach = k
                j += 1
                if score[j] == none:  # as bytes
                    score[j], back[j] = here + penalty, j - 1
                if reach <= j:
                    cut = j
                elif j - checked < window:
                    continue
                else:
                    cut, checked = self.meeting(score, back, j, reach), j
                if cut:
                    yield self.ids_of(text, back, cut, own)
                    if cut == n:
                        text, score, back, j, reach, checked, stop, n = "", score[n:], [0], 0, 0, 0, 0, 0
                    else:
                        text, score, back = text[cut:], score[cut:], [b - cut if b > cut else 0 for b in back[cut:]]
                        j, reach, checked, stop, n = j - cut, reach - cut, max(0, checked - cut), stop - cut, n - cut

    @staticmethod
    def meeting(score, back, j: int, reach: int) -> int:
        """The last boundary that the paths to all places from ``j`` to ``reach`` share; 0 for none but the start."""
        alive = {i for i in range(j, reach + 1) if score[i] != NONE}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last])
        return min(alive.pop(), j)

    def ids_of(self, text, back, end, own) -> list[int]:
        """The ids of the best path to ``end``."""
        m, out = self.model, []
        while end > 0:
            piece, end = text[back[end] : end], back[end]
            number = m.number.get(piece)
            if number is not None:
                out.append(number)
            elif m.bytes:
                out += [m.bytes[x] for x in reversed((SPACE if piece == own else piece).encode("utf-8", "replace"))]
            else:
                out.append(m.unknown)
        out.reverse()
        return out

    def searched(self, stretch: str, own: str | None = None) -> bytes:
        parts = (stretch,) if len(stretch) <= FEED else (stretch[i : i + FEED] for i in range(0, len(stretch), FEED))
        return b"".join([array("I", ids).tobytes() for ids in self.stream(parts, own)])

    def compute(self, stretch: str) -> bytes:
        return self.searched(stretch.replace(" ", SPACE))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if SPACE in text:
            own = next(chr(c) for some in STAND_INS for c in some if chr(c) not in text)
            return self.searched(SPACE + text.replace(SPACE, own).replace(" ", SPACE), own)
        if self.model.words:
            return b"".join(map(self.__getitem__, WORDS.findall(" " + text)))
        return self.searched(SPACE + text.replace(" ", SPACE))

    def decode(self, ids) -> str:
        return b"".join(map(self.model.text_of.__getitem__, ids))[1:].decode("utf-8", "replace")


def encoder_of(model: str | bytes) -> Encoder:
    """An encoder from a model file: its path, or its bytes for executors that need not see the file."""
    if isinstance(model, str):
        return Encoder(Model(model))
    with tempfile.NamedTemporaryFile(suffix=".model") as f:  # read at once, then gone
        f.write(model)
        f.flush()
        return Encoder(Model(f.name))


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array), ``n_tokens``, ``ids_crc32`` and ``exact`` (decoding gave the text back)."""
    names = ("ids", "n_tokens", "ids_crc32", "exact")
    keep = [c for c in docs.columns if c.lower() not in names]
    schema = extended(docs, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("exact", T.BooleanType()))

    shared = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches):
        encoder = encoder_of(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                packed, crc, exact = [], [], []
                for value in batch.column(0):
                    value = value.as_py() or ""
                    packed.append(encoder.encode(value))
                    crc.append(zlib.crc32(packed[-1]))
                    exact.append(encoder.decode(np.frombuffer(packed[-1], np.int32).tolist()) == value)
                sizes = np.array([len(x) // 4 for x in packed], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids, pa.array(sizes), pa.array(crc, pa.int64()), pa.array(exact, pa.bool_())], [*keep, *names])

    return docs.select(F.col(text).cast("string").alias("_encoded_text"), *keep).mapInArrow(lean(run), schema)


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, exact of every document; a merge model's ids are those of the best cut under Zipf scores."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_crc32", "exact")
