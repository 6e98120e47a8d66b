"""Token ids in binary shards: one zstandard frame per document, a shared dictionary, an offset index.

Format (little-endian). `shard-<k>.tok`: the frames of its documents, one after another; each holds the ids as unsigned
integers of `id_bytes` bytes. `shard-<k>.idx`: one record of INDEX per document in the same order: doc_id and whether it
is null, offset and length of its frame, n_tokens. `dictionary.bin` is the dictionary. `manifest.json` has its SHA-256,
id_bytes, end_id, and for each shard its documents, its ids, the ids before it, its first and last doc_id. To read one document
by its id, the shards whose range holds it are searched by halving the records of their index; then its frame alone is read.
A reader refuses a dictionary with another hash.

Documents stand in ascending doc_id order (null first, equal ids in the order of the input) within and across shards. They
are encoded and compressed where they are read; only their frames are then dealt by ranges of (doc_id, place in the input), so rows that
share an id are spread over shards like any others and no text is shuffled or sorted. The number of shards follows the bytes of all texts.
Files are written under a name of the attempt and then renamed, so a task that runs again replaces whole files.

Memory of a worker does not grow with the input: texts are encoded in stretches of about STRETCH bytes, after each of which freed memory
is handed back, long ones are cut where the tokenizer cuts anyway, and remembered pieces are bounded by their bytes (MEMO_PIECES of SHORT bytes).

Defined cases: a null text is encoded as the empty text, so it holds the end id only; an empty table gives a manifest
without shards; repeated rows are written each; further columns are ignored; ids that don't fit id_bytes are refused before
anything is written (by default id_bytes follows the vocabulary: 2, or 4 from 65,536 ids on).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import discard, hand_back, per_worker, slices, work_folder, written

#: The dictionary is trained on pieces of the id arrays of about SAMPLE_DOCS documents, both chosen by hash, from all places of
#: whole documents: at most SAMPLE_PIECES pieces of PIECE_IDS ids. Every document is encoded with it.
SAMPLE_DOCS = 2_000
SAMPLE_PIECES = 4_000
PIECE_IDS = 2_048
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Bytes of text of a shard, about.
SHARD_BYTES = 64 << 20
#: Bytes of text that are encoded at a time.
STRETCH = 1 << 20
#: Pieces that a worker remembers, 48 bytes each and 4 for each id (some 32 MB in all); a piece over SHORT bytes is never remembered.
MEMO_PIECES = 500_000
SHORT = 23

INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level BPE writes bytes as: printable ones as themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _class(members: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SPACE = _class([9, 10, 11, 12, 13, 32])
_LETTER = _class([*range(65, 91), *range(97, 123)])
_MARK = _class(b for b in range(128) if b not in (9, 10, 11, 12, 13, 32) and not _LETTER[b])
_SOLID = _class(b for b in (*range(128), *range(0xC3, 0xE0), *range(0xE4, 0xF5)) if not _SPACE[b])  # first bytes of characters that are no space
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Pieces that the pattern of byte-level BPE keeps together: letters, digits or marks after a space or not, a line feed.
_ONE = r"^(?: ?(?:[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{401}\x{410}-\x{44F}\x{451}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n)\z"
# Odd multipliers of the 64-bit mix.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Encoder:
    """Texts to their ids, as the tokenizers library encodes each whole text without adding special tokens.

    Byte-level BPE splits a text before it merges: always where white space begins, after a single line feed, and between a
    letter and a mark or digit. Texts are cut there, the distinct pieces of a stretch are found by their bytes, and each goes
    through the library once while it is remembered: pieces of one kind of character through its model, any other piece
    through all of it. Texts with a special token in them go through the library whole, as do all texts if the tokenizer is of another kind.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.plain = Tokenizer.from_file(tokenizer_path)  # for pieces that are cut already
        self.plain.pre_tokenizer = None
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        described = json.loads(self.tokenizer.to_str())
        split = described.get("pre_tokenizer") or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not described.get("normalizer") and described["model"]["type"] == "BPE"
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        vocabulary = self.tokenizer.get_vocab()
        self.cuts = bool(self.cuts and vocabulary.keys() >= set(_byte_letters().values()))
        self.chars = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.chars[list(vocabulary.values())] = [len(w) for w in vocabulary]
        self.letters = np.array([ord(c) for _, c in sorted(_byte_letters().items())], "<u4")
        self._forget()

    def _forget(self) -> None:
        # what is remembered: hash (ascending), bytes, place and number of the ids of each piece
        self.hash, self.key = np.empty(0, np.uint64), np.empty((0, 3), np.uint64)
        self.place, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places where pieces begin, the starts of texts included."""
        here, before = data[1:], data[:-1]
        # after a character beyond ASCII only where its first byte shows that it is no space
        high = before >= 0x80
        plain = ~_SPACE[before] & ~high
        if high.any():
            pad = np.concatenate([np.zeros(3, np.uint8), data])
            two, three, four = pad[2:-2], pad[1:-3], pad[:-4]  # one, two and three bytes before `before`
            plain |= high & (((two >= 0xC3) & (two < 0xE0)) | ((three >= 0xE4) & (three < 0xF0)) | (four >= 0xF0))
        mark = np.zeros(len(data) + 1, bool)
        mark[1:-1] = (_SPACE[here] & plain) | (_MARK[here] & _LETTER[before])
        mark[starts] = True
        mark[1:-1] |= mark[:-2] & (before == 10) & _SOLID[here]
        return np.flatnonzero(mark[:-1])

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a stretch of bytes and, for each of its texts, how many ids stand before it."""
        cuts = self._cuts(data, starts)
        size = np.diff(np.append(cuts, len(data)))
        padded = np.concatenate([data, np.zeros(24, np.uint8)])
        eight = np.ndarray((len(data) + 17,), "<u8", padded, strides=(1,))
        key = np.stack([eight[cuts + 8 * k] & _LOW[np.clip(size - 8 * k, 0, 8)] for k in range(3)], 1)
        short = size <= SHORT
        key[:, 2] |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)  # the length takes the place of a 24th byte
        hashed = (key[:, 0] * _MIX[0]) ^ (key[:, 1] * _MIX[1]) ^ (key[:, 2] * _MIX[2])
        hashed ^= hashed >> np.uint64(32)
        hashed[~short] = np.flatnonzero(~short)  # long pieces are each their own
        found = pa.array(hashed).dictionary_encode()
        which = found.indices.to_numpy()
        rep = np.empty(len(found.dictionary), np.int64)
        rep[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if not ((key == key[rep[which]]).all(1) | ~short).all():  # two pieces of one hash
            rep, which = np.arange(len(cuts)), np.arange(len(cuts))
        own = hashed[rep]
        at = np.searchsorted(self.hash, own)
        at[at == len(self.hash)] = 0
        known = ((self.hash[at] == own) & (self.key[at] == key[rep]).all(1) & short[rep]) if len(self.hash) else np.zeros(len(rep), bool)
        new = np.flatnonzero(~known)
        ids, count = self._fresh(data, cuts[rep[new]], size[rep[new]])
        length = np.empty(len(rep), np.int64)
        first = np.empty(len(rep), np.int64)
        length[known], first[known] = self.count[at[known]], self.place[at[known]]
        length[new], first[new] = count, len(self.ids) + np.cumsum(count) - count
        store = np.concatenate([self.ids, ids])
        n = length[which]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        out = store[np.repeat(first[which] - (upto - n), n) + np.arange(total)]
        self._remember(own, key[rep], first, length, new, store, short[rep])
        return out, np.concatenate([[0], upto])[np.searchsorted(cuts, starts)]

    def _fresh(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        if not len(at):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        ends = np.cumsum(size)
        packed = data[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
        offsets = np.concatenate([[0], ends])
        # the characters that the model reads, one for each byte
        letters, o = self.letters[packed].tobytes().decode("utf-32-le"), offsets.tolist()
        words = [letters[a:b] for a, b in zip(o, o[1:])]
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
        one = pc.match_substring_regex(pieces, _ONE).to_numpy(zero_copy_only=False)
        ids, count = self._words([w for w, fine in zip(words, one.tolist()) if fine])
        if one.all():
            return ids, count
        raw = packed.tobytes()
        other = [self.whole(raw[o[k] : o[k + 1]].decode()) for k in np.flatnonzero(~one).tolist()]
        length = np.empty(len(at), np.int64)
        length[one], length[~one] = count, [len(x) for x in other]
        out = np.empty(int(length.sum()), "<u4")
        mine = np.repeat(one, length)
        out[mine], out[~mine] = ids, np.concatenate(other)
        return out, length

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in the model's characters, each merged by itself."""
        ids, count = [], []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            got = np.array(self.plain.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ids.append(got)
            # the characters of its tokens tell where a word ends
            ends = np.searchsorted(np.cumsum(self.chars[got]), np.cumsum([len(w) for w in part])) + 1
            count.append(np.diff(ends, prepend=0))
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate([np.empty(0, np.int64), *count])

    def _remember(self, own, key, first, length, new, store, short) -> None:
        keep = new[short[new]]
        if not len(keep):
            return
        if len(self.hash) + len(keep) > MEMO_PIECES:  # start again from the pieces of this stretch
            keep = np.flatnonzero(short)[:MEMO_PIECES]
            self._forget()
        hash_, key_ = np.concatenate([self.hash, own[keep]]), np.concatenate([self.key, key[keep]])
        place, count = np.concatenate([self.place, first[keep]]), np.concatenate([self.count, length[keep]])
        order = np.argsort(hash_, kind="stable")
        self.hash, self.key, place, self.count = hash_[order], key_[order], place[order], count[order]
        upto = np.cumsum(self.count)
        self.place = upto - self.count
        self.ids = store[np.repeat(place - self.place, self.count) + np.arange(int(upto[-1]))]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """A long text in stretches, cut before spaces that follow a letter."""
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + STRETCH)
            while end < len(data):
                part = data[at:end]
                cut = np.flatnonzero((part[1:] == 32) & _LETTER[part[:-1]])
                if len(cut):
                    end = at + int(cut[-1]) + 1
                    break
                end = min(len(data), end + STRETCH)
            out.append(self._pieces(data[at:end], np.zeros(1, np.int64))[0])
            at = end
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first, ids, bounds) of runs of texts: ids of the texts from `first` on, text k of a run in ids[bounds[k]:bounds[k + 1]]."""
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        if self.cuts:
            for special in self.specials:
                odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        else:
            odd[:] = True
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
        at = 0
        while at < len(texts):
            size = int(offsets[at + 1] - offsets[at])
            if odd[at]:
                ids = self.whole(texts[at].as_py()) if size else np.empty(0, "<u4")
                end, bounds = at + 1, np.array([0, len(ids)])
            elif size > STRETCH:
                ids = self._long(data[offsets[at] : offsets[at + 1]])
                end, bounds = at + 1, np.array([0, len(ids)])
            else:
                end = int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1
                stop = np.flatnonzero(odd[at:end])
                end = at + int(stop[0]) if len(stop) else end
                part = data[offsets[at] : offsets[end]]
                ids, before = self._pieces(part, offsets[at:end] - offsets[at]) if len(part) else (np.empty(0, "<u4"), np.zeros(end - at, np.int64))
                bounds = np.append(before, len(ids))
            yield at, ids, bounds
            at = end

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        return [ids[a:b].tobytes() for _, ids, bounds in self.encode(pa.array(texts, pa.string())) for a, b in zip(bounds, bounds[1:])]


def encoder(tokenizer_path: str) -> Encoder:
    """One encoder, and what it remembers, for each worker process."""
    return per_worker(("encoder", tokenizer_path), lambda: Encoder(tokenizer_path))


def train_dictionary(docs: DataFrame, tokenizer_path: str, id_bytes: int) -> bytes:
    """A zstandard dictionary from pieces of the id arrays of about SAMPLE_DOCS documents; empty if they are too few."""
    slots = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)) == 0).select("text")

    def pieces(batches):
        encode = encoder(tokenizer_path)
        for batch in batches:
            for _, ids, bounds in encode.encode(batch.column(0)):
                found = [ids[at : min(b, at + PIECE_IDS)].astype(f"<u{id_bytes}").tobytes() for a, b in zip(bounds, bounds[1:]) for at in range(int(a), int(b), PIECE_IDS)]
                yield pa.RecordBatch.from_pydict({"h": pa.array([zlib.crc32(p) for p in found], pa.int64()), "piece": pa.array(found, pa.binary())})

    # those of the smallest hashes: the same pieces, and so the same dictionary, whatever the order of arrival
    got = sample.mapInArrow(pieces, "h long, piece binary").distinct().orderBy("h", "piece").limit(SAMPLE_PIECES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["piece"]) for r in got], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)  # once for all documents
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_bytes: int | None = None, shard_bytes: int = SHARD_BYTES) -> dict:
    """Encode docs (doc_id, text), append end_id to each and write the files into folder, a URI that all
    executors reach. Returns the manifest, which is also written."""
    spark = docs.sparkSession
    largest = max(Encoder(tokenizer_path).size - 1, end_id)
    id_bytes = id_bytes or (2 if largest < 1 << 16 else 4)
    if end_id < 0 or largest >= 1 << (8 * id_bytes):
        raise ValueError(f"ids up to {largest} do not fit {id_bytes} bytes")
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer_path, id_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.bin") as f:
        f.write(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, -(-size // shard_bytes))
    # the place tells rows of one id apart, so that ranges can part them
    placed = docs.select("doc_id", F.monotonically_increasing_id().alias("_place"), "text")

    def compress(batches):
        encode, pack, since = encoder(tokenizer_path), _compressor(sent.value), 0
        for batch in batches:
            for at, ids, bounds in encode.encode(batch.column(2)):
                n = len(bounds) - 1
                ids = np.insert(ids, bounds[1:], end_id).astype(f"<u{id_bytes}")
                bounds = bounds + np.arange(n + 1)
                view, b = memoryview(ids).cast("B"), (bounds * id_bytes).tolist()
                made = pa.array([pack.compress(view[x:y]) for x, y in zip(b, b[1:])], pa.binary())
                keys = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), pa.array(np.diff(bounds), pa.int64()), made], names=["doc_id", "_place", "n_tokens", "frame"])
                since += len(ids)
                if since * 8 >= STRETCH:  # a stretch, or as many short runs
                    del ids, view, made, keys
                    hand_back()
                    since = 0

    frames = written(placed.mapInArrow(compress, "doc_id long, _place long, n_tokens long, frame binary"), "frames")
    dealt = frames.repartitionByRange(n_shards, "doc_id", "_place").sortWithinPartitions("doc_id", "_place").select("doc_id", "n_tokens", "frame")

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        shard, attempt, offset, index, first = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, [], None
        out = None
        for batch in batches:
            if batch.num_rows and out is None:
                out = fs.open_output_stream(f"{root}/.{attempt}.tok")
            for piece in slices([batch]):
                made = piece.column(2).to_pylist()
                out.write(b"".join(made))
                part = np.empty(len(made), INDEX)
                part["doc_id"], part["null"] = pc.fill_null(piece.column(0), 0).to_numpy(), piece.column(0).is_null().to_numpy(zero_copy_only=False)
                part["length"] = [len(f) for f in made]
                part["offset"] = offset + np.cumsum(part["length"], dtype=np.uint64) - part["length"]
                part["n_tokens"] = piece.column(1).to_numpy()
                offset += int(part["length"].sum(dtype=np.uint64))
                index.append(part)
        if out is not None:
            out.close()
            index = np.concatenate(index)  # of one shard
            with fs.open_output_stream(f"{root}/.{attempt}.idx") as f:
                f.write(index.tobytes())
            for kind in ("tok", "idx"):
                fs.move(f"{root}/.{attempt}.{kind}", f"{root}/shard-{shard:06d}.{kind}")
            first, last = ([None if index["null"][k] else int(index["doc_id"][k])] for k in (0, -1))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([shard], [len(index)], [int(index["n_tokens"].sum(dtype=np.int64))], first, last), (pa.int32(), *[pa.int64()] * 4))], names=["shard", "docs", "ids", "first", "last"])

    # one row per shard
    done = dealt.mapInArrow(write, "shard int, docs long, ids long, first long, last long").collect()
    discard(frames)
    before, shards = 0, []
    for r in sorted(done, key=lambda r: r["shard"]):
        shards.append(r.asDict() | {"start": before})
        before += r["ids"]
    manifest = {"format": 2, "dictionary_sha256": digest, "id_bytes": id_bytes, "end_id": end_id, "shards": shards}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _load(folder: str) -> tuple[pafs.FileSystem, str, dict, bytes]:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    with fs.open_input_stream(f"{root}/dictionary.bin") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != manifest["dictionary_sha256"]:
        raise ValueError("the dictionary is not the one that these shards were written with")
    return fs, root, manifest, dictionary


class TokenReader:
    """Documents of token files by their id."""

    def __init__(self, folder: str):
        self.fs, self.root, self.manifest, dictionary = _load(folder)
        self.unpack = _decompressor(dictionary)

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this id, in the order of the files; none: an empty list."""
        key, out = _key(doc_id), []
        for s in self.manifest["shards"]:
            if _key(s["first"]) <= key <= _key(s["last"]):
                out += self._in_shard(s, key)
        return out

    def _in_shard(self, shard: dict, key: tuple) -> list[np.ndarray]:
        name, out = f"{self.root}/shard-{shard['shard']:06d}", []
        with self.fs.open_input_file(f"{name}.idx") as index, self.fs.open_input_file(f"{name}.tok") as frames:

            def record(k: int) -> np.void:
                index.seek(k * INDEX.itemsize)
                return np.frombuffer(index.read(INDEX.itemsize), INDEX)[0]

            low, high = 0, shard["docs"]
            while low < high:
                middle = (low + high) // 2
                r = record(middle)
                low, high = (middle + 1, high) if _key(None if r["null"] else int(r["doc_id"])) < key else (low, middle)
            while low < shard["docs"]:
                r = record(low)
                if _key(None if r["null"] else int(r["doc_id"])) != key:
                    break
                frames.seek(int(r["offset"]))
                out.append(np.frombuffer(self.unpack.decompress(frames.read(int(r["length"]))), dtype=f"<u{self.manifest['id_bytes']}").astype("<u4"))
                low += 1
        return out


def _key(doc_id: int | None) -> tuple:
    return (doc_id is not None, doc_id or 0)


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32; with `ids` also the id array."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    _, _, manifest, _ = _load(folder)
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    places = [(s["shard"], s["start"], s["docs"]) for s in manifest["shards"]]
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if ids else []))

    def read(batches):
        fs, root, manifest, dictionary = _load(folder)
        unpack, kind = _decompressor(dictionary), f"<u{manifest['id_bytes']}"
        for piece in batches:
            for shard, start, n in zip(*[c.to_pylist() for c in piece.columns]):
                name = f"{root}/shard-{shard:06d}"
                with fs.open_input_stream(f"{name}.tok") as frames, fs.open_input_stream(f"{name}.idx") as index:
                    for at in range(0, n, 512):
                        part = np.frombuffer(index.read(min(512, n - at) * INDEX.itemsize), INDEX)
                        starts = start + np.cumsum(part["n_tokens"], dtype=np.int64) - part["n_tokens"]
                        sums, values = [], []
                        for length in part["length"].tolist():
                            found = np.frombuffer(unpack.decompress(frames.read(length)), dtype=kind).astype("<u4")
                            sums.append(zlib.crc32(found))
                            if ids:
                                values.append(found.astype("i4"))
                        start += int(part["n_tokens"].sum(dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([pa.array(part["doc_id"], pa.int64(), mask=part["null"].astype(bool)), starts, part["n_tokens"].astype(np.int64), sums, values], kinds.types)], names=kinds.names)

    return spark.createDataFrame(places, "shard int, start long, docs int").repartition(len(places)).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, **params) -> DataFrame:
    """Write docs as token files and return what is read back from them."""
    folder = folder or work_folder(docs.sparkSession) + "/tokens"
    write_tokens(docs, folder, tokenizer_path, end_id, **params)
    return read_tokens(docs.sparkSession, folder)
