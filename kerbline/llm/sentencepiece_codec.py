"""SentencePiece BPE encoding by backtracking, and decoding.

An Aho-Corasick automaton over the pieces gives every match of a chunk. The encoder takes the longest
piece, then checks that it may stand next to the piece before it: the two joined and merged again
from single characters, best score first and leftmost among equals, must give the same two. If not
it tries the next shorter piece, and if none is left it steps back and marks the position as failed
in a bit field, so no position is explored twice. The result is exactly that of merging.

No piece holds a space mark after another character, and none a line feed; both are checked when the
model is loaded. So a text falls into chunks of a space mark and a word, which are encoded apart and
remembered in a bounded memo. Runs of space marks merge only after all else, as their pieces have
the lowest score; a chunk keeps the mark nearest to its word and the rest of a run is merged alone.

Defined cases: a null text is encoded as an empty one, with no ids; a repeated row gets the same
answer again; chunks of any length are handled in blocks; other columns are ignored by the query
and kept by the stage; null ids stay null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import small_batches

MARK, BLOCK, MEMO, FITS = "▁", 4096, 150_000, 200_000
_models: dict[str, "Codec"] = {}


def load(path: str) -> "Codec":
    """The model at path; each Python worker reads it once."""
    if path not in _models:
        _models[path] = Codec(path)
    return _models[path]


class _Memo(dict):
    """chunk -> (ids as text joined by commas, ids as int32 bytes, decoded text).

    When full it becomes the old generation, from which what is still in use is taken over, so at
    most twice MEMO chunks are held.
    """

    def __init__(self, codec: "Codec", lead: str):
        super().__init__()
        self.codec, self.lead, self.old = codec, lead, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            ids = self.codec.encode_chunk(self.lead + word)
            found = (",".join(map(str, ids)), array("i", ids).tobytes(), self.codec.decode_ids(ids))
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Codec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.byte_id, self.byte_of = {}, {}
        self.score, self.number = {}, {}
        for i, p in enumerate(self.piece):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[p], self.number[p] = model.get_score(i), i
        if any(MARK in p.lstrip(MARK) or "\n" in p or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.score):
            raise ValueError("pieces of this model cross the places at which texts are cut")
        self.control = {i for i in range(size) if model.is_control(i)}
        self.text = [None if i in self.byte_of else "" if i in self.control else p.replace(MARK, " ") for i, p in enumerate(self.piece)]
        self.longest = max(map(len, self.score))
        matcher = ahocorasick.Automaton()
        for p in self.score:
            if len(p) > 1:  # single characters match everywhere and are put in at once
                matcher.add_word(p, (len(p) - 1, p))
        matcher.make_automaton()
        self.matcher = matcher
        self.fits: dict[tuple[str, str], bool] = {}
        self.marked, self.plain, self.runs = _Memo(self, MARK), _Memo(self, ""), {}

    def merged(self, text: str) -> list[str]:
        """Single characters merged pair by pair: the best score first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, last: str | None, piece: str) -> bool:
        key = (last, piece)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            found = self.fits[key] = self.merged((last or "") + piece) == ([piece] if last is None else [last, piece])
        return found

    def _matches(self, text: str, block: int) -> list[list[str]]:
        """For each start in a block, the pieces that match there, shortest first."""
        lo = block * BLOCK
        out = [[c] for c in text[lo : lo + BLOCK]]
        size = len(out)
        for end, (before, p) in self.matcher.iter(text[lo : lo + size + self.longest]):
            if end - before < size:
                out[end - before].append(p)
        return out

    def pieces_of(self, text: str) -> list[str]:
        """The pieces of a chunk by backtracking."""
        if len(text) <= 64:
            return self._pieces_of_word(text)
        blocks: dict[int, list[list[str]]] = {}
        failed = bytearray((len(text) >> 3) + 1)
        out: list[str] = []
        tried: list[int] = []  # for each piece of out, its number among the matches at its start
        at, i = 0, None
        while at < len(text):
            block = at // BLOCK
            if block not in blocks:
                if len(blocks) >= 4:
                    blocks.pop(min(blocks) if min(blocks) < block else max(blocks))
                blocks[block] = self._matches(text, block)
            here = blocks[block][at % BLOCK]
            i = len(here) - 1 if i is None else i
            last = out[-1] if out else None
            while i >= 0:
                end = at + len(here[i])
                if not failed[end >> 3] >> (end & 7) & 1 and self._may_follow(last, here[i]):
                    break
                i -= 1
            if i >= 0:
                out.append(here[i])
                tried.append(i)
                at, i = end, None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                i = tried.pop() - 1
        return out

    def _pieces_of_word(self, text: str) -> list[str]:
        """The same for a short chunk: all matches at once, the bit field in one integer."""
        size = len(text)
        here = [[c] for c in text]
        for end, (before, p) in self.matcher.iter(text):
            here[end - before].append(p)
        out: list[str] = []
        failed, at, last, fits = 0, 0, None, self.fits
        while at < size:
            matches = here[at]
            while matches:
                piece = matches.pop()  # what was tried once at a place fails there for good
                end = at + len(piece)
                if failed >> end & 1:
                    continue
                good = fits.get((last, piece))
                if good if good is not None else self._may_follow(last, piece):
                    out.append(piece)
                    at, last = end, piece
                    break
            else:
                failed |= 1 << at
                at -= len(out.pop())
                last = out[-1] if out else None
        return out

    def _run(self, n: int) -> list[str]:
        """Pieces of n space marks: merged from the left, equal scores throughout."""
        if n not in self.runs:
            left, size = list(range(-1, n - 1)), [1] * n
            right = [*range(1, n), -1]
            heap = [(-self.score[MARK * 2], i, 2) for i in range(n - 1)] if MARK * 2 in self.score else []
            heapq.heapify(heap)
            while heap:
                _, i, total = heapq.heappop(heap)
                j = right[i]
                if not size[i] or j < 0 or size[i] + size[j] != total:
                    continue
                size[i], size[j] = total, 0
                right[i] = right[j]
                if right[i] >= 0:
                    left[right[i]] = i
                for a in (left[i], i):
                    if a >= 0 and right[a] >= 0 and (s := self.score.get(MARK * (size[a] + size[right[a]]))) is not None:
                        heapq.heappush(heap, (-s, a, size[a] + size[right[a]]))
            found = [MARK * s for s in size if s]
            if n > 1000:
                return found
            self.runs[n] = found
        return self.runs[n]

    def ids_of(self, pieces: list[str]) -> list[int]:
        try:
            return [self.number[p] for p in pieces]
        except KeyError:
            out: list[int] = []
        for p in pieces:
            i = self.number.get(p)
            if i is None:
                out.extend(self.byte_id[b] for b in p.encode())
            else:
                out.append(i)
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk: any number of space marks, then a word or nothing."""
        marks = len(chunk) - len(chunk.lstrip(MARK))
        if marks < 2 and len(chunk) > marks:
            return self.ids_of(self.pieces_of(chunk))
        if len(chunk) == marks:
            return self.ids_of(self._run(marks))
        pieces = self.pieces_of(chunk[marks - 1 :])
        if pieces[0] == MARK:
            return self.ids_of(self._run(marks) + pieces[1:])
        return self.ids_of(self._run(marks - 1) + pieces)

    def decode_ids(self, ids: list[int]) -> str:
        """The text of some ids with every space mark as a space; ids that are no text give none."""
        try:
            return "".join([self.text[i] for i in ids])
        except TypeError:  # a byte, which has no text of its own
            out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                out.append(self.piece[i].replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def encoded(self, text: str) -> list[tuple[str, bytes, str]]:
        """The chunks of a text, each with its ids and its decoded text."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        out: list[tuple[str, bytes, str]] = []
        feed = self.plain["\n"]
        marked, plain = self.marked.__getitem__, self.plain.__getitem__
        for number, line in enumerate(text.split("\n")):
            if number:
                out.append(feed)
            elif not line or line[0] == " ":
                line = " " + line  # the mark before the text starts a run or stands alone
                number = -1
            if not line:
                continue
            if "  " in line or line[0] == " " or line[-1] == " ":
                out.extend(self._with_runs(line, number == 0))
                continue
            words = line.split(" ")
            out.append(marked(words[0]) if number == 0 else plain(words[0]))
            out.extend(map(marked, words[1:]))
        return out

    def _with_runs(self, line: str, first: bool) -> list[tuple[str, bytes, str]]:
        out, marks = [], int(first)
        for i, word in enumerate(line.split(" ")):
            marks += i > 0
            if word:
                out.append(self.marked[word] if marks == 1 else self.plain[word] if not marks else self.plain[MARK * marks + word])
                marks = 0
        if marks:
            out.append(self.plain[MARK * marks])
        return out


def codec_path() -> str:
    """The default model of this box; a path is a parameter of every function that needs one."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row, with the ids themselves if asked for."""
    small_batches(docs.sparkSession)
    path = path or codec_path()

    def kernel(batches):
        codec = load(path)
        for batch in batches:
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                n, ids_hash, text_hash, held, at = [], [], [], [], [0]
                for text in part.column(1).to_pylist():
                    chunks = codec.encoded(text or "")
                    ids = ",".join([c[0] for c in chunks])
                    decoded = "".join([c[2] for c in chunks])
                    decoded = decoded[1:] if decoded[:1] == " " else decoded
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        held.append(b"".join([c[1] for c in chunks]))
                        at.append(at[-1] + n[-1])
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    values = pa.Array.from_buffers(pa.int32(), at[-1], [None, pa.py_buffer(b"".join(held))])
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).cast("bigint"), F.col("text").cast("string")).mapInArrow(kernel, schema)


def decode(rows: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """key and the text of the ids of every row; null ids give null."""
    path = path or codec_path()

    def kernel(batches):
        codec = load(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                text = None if ids is None else codec.decode_ids(ids)
                texts.append(text[1:] if text and text[0] == " " else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return rows.select(F.col(key).cast("bigint"), "ids").mapInArrow(kernel, f"{key} long, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of encode over the whole documents table."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the token ids of every document that is left, with their digests."""
    return encode(docs, with_ids=True)


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLES: dict = {}
