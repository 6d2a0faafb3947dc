"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is marked (blanks become U+2581, one is put in front) and cut into words. The distinct words of a block are sorted,
which lists a trie depth-first: what was computed for a word's first characters is kept for the next word, up to their
common prefix.

The forward step of a unigram model: the best score of every prefix of a word and the last token on its path, over all pieces that
end there; of equal scores the longer piece.

The forward step of a BPE model: for every prefix of a word, the last token of its encoding. Scores are merge ranks there, and the
encoding is not the path of the best score sum; scores summed along a path would give
other ids than the model's own. The step thus takes, of the pieces that end at a position, the one that is compatible
with the last token before it: merging the two tokens' characters by rank must give back these two tokens. A
sequence is the model's encoding if and only if all its neighbours are compatible, and for each prefix just one
piece is. Results equal the sentencepiece library's ids, with byte fallback for characters outside the vocabulary, or
one unknown id for a run of them where the model has no bytes.

Model files of other types, with a normalising table, without the mark in front, with extra blanks removed, or with
pieces of the user's own are refused, as their ids would be others.

Defined results: null text gives null ids and 0 tokens; empty text gives no ids. U+2581 in a text decodes as a blank. Every row gives
one row, repeated rows too; an empty table gives no rows. Long texts are cut into words like any other, and a word may be as long as it likes.
Other columns are passed on untouched, whatever their names; only an older column with the output's name is replaced.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def fields(raw: bytes) -> dict[int, list]:
    """The fields of one protocol buffer message: numbers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number():
        nonlocal at
        x = shift = 0
        while True:
            byte = raw[at]
            at += 1
            x |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return x

    while at < len(raw):
        key = number()
        size = {0: None, 1: 8, 5: 4}.get(key & 7, -1)
        if size is None:
            value = number()
        else:
            if size < 0:
                size = number()
            value = raw[at : at + size]
            at += size
        out.setdefault(key >> 3, []).append(value)
    return out


#: Model types and kinds of pieces in model files.
UNIGRAM, BPE = 1, 2
USER_DEFINED = 4


def check_model(raw: bytes) -> int:
    """The type of a serialized model; raises if its ids would not be those of this module."""
    top = fields(raw)
    trainer, normal = (fields(top.get(i, [b""])[0]) for i in (2, 3))
    kind = trainer.get(3, [UNIGRAM])[0]
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind}: only unigram and BPE models are read")
    if normal.get(2, [b""])[0]:
        raise ValueError("the model normalises characters by a table")
    if normal.get(3, [1])[0] != 1 or normal.get(4, [1])[0] != 0 or normal.get(5, [1])[0] != 1 or trainer.get(24, [0])[0]:
        raise ValueError("the model must put a mark in front, keep all blanks and mark them")
    if any(fields(p).get(3, [1])[0] == USER_DEFINED for p in top.get(1, [])):
        raise ValueError("pieces of the user's own are not supported")
    return kind


def load_vocabulary(model_file: str = DEFAULT_MODEL) -> dict:
    """Pieces, scores and byte ids of a model file, read once on the driver; its size is the vocabulary's, fixed."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    raw = sp.serialized_model_proto()
    kind = check_model(raw)
    ids, scores, by_byte, table = {}, {}, {}, []
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            by_byte[int(piece[3:5], 16)] = i
            table.append(bytes((int(piece[3:5], 16),)))
        elif sp.is_unknown(i):
            table.append(" \u2047 ".encode())
        elif sp.is_control(i) or sp.is_unused(i):
            table.append(b"")
        else:
            ids[piece], scores[piece] = i, sp.get_score(i)
            table.append(piece.replace(MARK, " ").encode())
    return {"key": hashlib.sha256(raw).hexdigest(), "kind": kind, "ids": ids, "scores": scores, "bytes": [by_byte[i] for i in range(256)] if len(by_byte) == 256 else [], "unknown": sp.unk_id(), "table": table}


class Encoder:
    """Words to ids, with a bounded memory of words seen."""

    def __init__(self, vocabulary: dict, keep_words: int = 200_000):
        self.ids, self.scores, self.by_byte, self.table, self.unknown = (vocabulary[k] for k in ("ids", "scores", "bytes", "table", "unknown"))
        long = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            raise ValueError("pieces that span words are not supported")
        apart = "\n" if not any("\n" in p for p in long) else ""
        self.words = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + (f"|{apart}+" if apart else ""))
        # pieces spelled backwards, as nested dicts; at a piece's node, under 0, stand the piece and its answers by last token
        self.back: dict = {}
        for p in self.ids:
            node = self.back
            for ch in reversed(p):
                node = node.setdefault(ch, {})
            node[0] = (p, {})
        self.answers = 0
        self.known: dict[str, bytes] = {}  # ids as packed 32-bit numbers
        self.keep_words = keep_words
        self.learn = self.learn_bpe if vocabulary["kind"] == BPE else self.learn_unigram

    def merge(self, text: str) -> list[str]:
        """Plain BPE by rank, leftmost first; used on two tokens at a time."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, prev: str, token: str, answers: dict) -> bool:
        """Whether ``token`` may follow ``prev``; kept, as long as there are fewer than 600,000 answers."""
        ok = self.merge(prev + token) == ([prev, token] if prev else [token])
        if self.answers < 600_000:
            answers[prev] = ok
            self.answers += 1
        return ok

    def learn_unigram(self, words) -> None:
        """Encode distinct words depth-first over their trie: best score of each prefix, shared along common prefixes."""
        root, scores = self.back, self.scores
        least = min(scores.values(), default=0.0) - 10.0  # what the library takes for a character that is no piece
        best, last, before = [0.0], [""], ""
        for word in sorted(words):
            n = min(len(word), len(before))
            j = 0
            while j < n and word[j] == before[j]:
                j += 1
            del last[j + 1 :], best[j + 1 :]
            for j in range(j, len(word)):
                node, top, found = root, None, word[j]
                if found not in scores:
                    top = best[j] + least
                for k in range(j, -1, -1):
                    node = node.get(word[k])
                    if node is None:
                        break
                    piece = node.get(0)
                    if piece is not None:
                        value = best[k] + scores[piece[0]]
                        if top is None or value >= top:
                            top, found = value, piece[0]
                best.append(top)
                last.append(found)
            before = word
            self._keep(word, last)

    def learn_bpe(self, words) -> None:
        """Encode distinct words depth-first over their trie."""
        root = self.back
        last: list[str] = [""]  # last[j]: the last token of the first j characters' encoding
        before = ""
        for word in sorted(words):
            n = min(len(word), len(before))
            j = 0
            while j < n and word[j] == before[j]:
                j += 1
            del last[j + 1 :]
            for j in range(j, len(word)):
                node, found = root, word[j]
                for k in range(j, -1, -1):
                    node = node.get(word[k])
                    if node is None:
                        break
                    piece = node.get(0)
                    if piece is not None:
                        token, answers = piece
                        prev = last[k]
                        ok = answers.get(prev)
                        if self._fit(prev, token, answers) if ok is None else ok:
                            found = token
                            break
                last.append(found)
            before = word
            self._keep(word, last)

    def _keep(self, word: str, last: list[str]) -> None:
        ids, out, j = self.ids, [], len(word)
        while j:
            token = last[j]
            j -= len(token)
            i = ids.get(token)
            if i is not None:
                out.append(i)
            elif self.by_byte:
                out.extend(self.by_byte[b] for b in reversed(token.encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
        out.reverse()
        self.known[word] = array("i", out).tobytes()

    def _ids(self, words: list[str]) -> np.ndarray:
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
        if self.by_byte or not len(ids):
            return ids
        again = ids == self.unknown  # a run of unknown characters is one id
        again[1:] &= again[:-1].copy()
        again[0] = False
        return ids[~again]

    def encode(self, texts: list, chunk_chars: int = 4_000_000) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size < chunk_chars):
                t = texts[at]
                cut.append(None if t is None else self.words.findall(MARK + t.replace(" ", MARK)) if t else [])
                size += len(t or "")
                at += 1
            met = set().union(*filter(None, cut))
            new = met.difference(self.known)
            if len(new) + len(self.known) > self.keep_words:
                self.known.clear()
                new = met
            self.learn(new)
            out += [None if ws is None else self._ids(ws) for ws in cut]
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.table.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encoder_of(vocabulary: dict) -> Encoder:
    """The worker's encoder of a vocabulary: a Python worker keeps one from task to task, with the words that it knows."""
    held = sys.modules.setdefault("_tallyforge_encoder", types.ModuleType("_tallyforge_encoder")).__dict__
    if held.get("key") != vocabulary["key"]:
        held["key"], held["encoder"] = vocabulary["key"], Encoder(vocabulary)
    return held["encoder"]


def encode(docs: DataFrame, text_col="text", model_file: str = DEFAULT_MODEL, ids_col="piece_ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>); an older column of that name is replaced."""
    vocabulary = load_vocabulary(model_file)
    rest = [c for c in docs.columns if c != ids_col]
    at = rest.index(text_col)
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = encoder_of(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(encoder.encode(part.column(at).to_pylist()))], [*rest, ids_col])

    return docs.select(*rest).mapInArrow(run, schema)


def _lists(found: list) -> pa.ListArray:
    sizes = [0 if x is None else len(x) for x in found]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate([x for x in found if x is not None]) if any(sizes) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array([x is None for x in found]))


def decode(encoded: DataFrame, ids_col="piece_ids", model_file: str = DEFAULT_MODEL, out="decoded") -> DataFrame:
    """``encoded`` with ``out``: the text of the ids; null ids give null. Ids outside the vocabulary raise."""
    vocabulary = load_vocabulary(model_file)
    rest = [c for c in encoded.columns if c != out]
    at = rest.index(ids_col)

    def run(batches):
        encoder = Encoder(vocabulary)
        for b in batches:
            texts = [None if x is None else encoder.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*rest, out])

    return encoded.select(*rest).mapInArrow(run, T.StructType([*encoded.select(*rest).schema.fields, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, id_col="doc_id", text_col="text", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens, piece_ids, decoded_sha256, lossless): encode each text, decode the ids, compare."""
    vocabulary = load_vocabulary(model_file)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = encoder_of(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                texts = part.column(1).to_pylist()
                ids = encoder.encode(texts)
                back = [None if x is None else encoder.decode(x.tolist()) for x in ids]
                same = [None if t is None else t.replace(MARK, " ") == d for t, d in zip(texts, back)]
                sha = [None if d is None else hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in back]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([0 if x is None else len(x) for x in ids], pa.int64()), _lists(ids), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "piece_ids", "decoded_sha256", "lossless"],
                )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, piece_ids array<int>, decoded_sha256 string, lossless boolean")
