"""Help containers as DataFrames.

Each file is read once by Spark's binaryFile source and decoded in one Arrow task into records
(file, kind, ord, key, a, b, text, raw). Everything after is DataFrame operations: ``tables`` has a
typed view of each kind. What can't be decoded is a record of kind ``error``; it never fails a job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources import codec
from folioscope.sources.codec import Reader

MAGIC, TREE_MAGIC, SYSTEM_MAGIC = 0x00035F3F, 0x293B, 0x036C
#: Windows code pages by language and by character set.
BY_LANGUAGE = {0x0405: "cp1250", 0x0408: "cp1253", 0x040D: "cp1255", 0x040E: "cp1250", 0x0411: "cp932", 0x0412: "cp949", 0x0404: "cp950", 0x0804: "cp936", 0x0415: "cp1250", 0x0419: "cp1251", 0x041E: "cp874", 0x041F: "cp1254", 0x0401: "cp1256"}
BY_CHARSET = {0: "cp1252", 128: "cp932", 129: "cp949", 134: "cp936", 136: "cp950", 161: "cp1253", 162: "cp1254", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}
SYSTEM_KINDS = {1: "title", 2: "copyright", 3: "contents", 4: "macro", 5: "icon", 6: "window", 8: "citation", 9: "language", 10: "contents_file", 11: "charset", 12: "default_font", 13: "groups", 14: "key_index", 18: "language_name", 19: "dll_maps"}

RECORD = "file string, kind string, ord long, key string, a long, b long, text string, raw binary"


def decoded(data: bytes, encoding: str) -> str:
    """Text in the file's code page, or in the first of its fallbacks that fits."""
    for name in (encoding, "cp1252", "cp1251", "cp850"):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return data.decode("latin-1")


def leaves(data: bytes) -> Iterator[tuple[bytes, int]]:
    """The bytes of each leaf page of a tree, in order, and its number of entries."""
    r = Reader(data)
    magic, _, size = r.take("HHH")
    if magic != TREE_MAGIC:
        raise ValueError(f"a tree starts with {magic:#06x}")
    r.bytes(16)
    _, _, root, _, total, levels = r.take("6h")
    r.take("i")
    page = lambda k: data[38 + k * size : 38 + (k + 1) * size]
    now, seen = root, set()
    for _ in range(max(0, levels - 1)):
        now = struct.unpack_from("<h", page(now), 4)[0]
    while 0 <= now < total and now not in seen:
        seen.add(now)
        _, n, _, after = struct.unpack_from("<HhhH", page(now))
        yield page(now)[8:], n
        now = after if after != 0xFFFF else -1


def entries(data: bytes, *fields: str) -> Iterator[tuple]:
    """Entries of all leaves; z is a string that ends in zero, others are struct formats."""
    for page, n in leaves(data):
        r = Reader(page)
        for _ in range(n):
            yield tuple(r.zero_ended() if f == "z" else r.take(f) for f in fields)


class Container:
    """One file; ``records`` decodes all parts that it knows."""

    def __init__(self, name: str, data: bytes):
        self.name, self.data = name, data
        self.rows: list[tuple] = []
        self.encoding, self.minor, self.flags = "cp1252", 21, 0
        self.files: dict[str, bytes] = {}
        self.phrases: list[bytes] | None = None
        self.hall = False

    def add(self, kind: str, order: int, key: str | None = None, a: int | None = None, b: int | None = None, text: str | None = None, raw: bytes | None = None) -> None:
        self.rows.append((self.name, kind, order, key, a, b, text, raw))

    def guarded(self, part: str, f, *args) -> None:
        try:
            f(*args)
        except Exception as e:  # malformed input is a row, not a failure
            self.add("error", len(self.rows), part, text=f"{type(e).__name__}: {e}")

    def records(self) -> list[tuple]:
        self.guarded("header", self._directory)
        for part, f in (("|SYSTEM", self._system), ("|Phrases", self._phrases), ("|PhrIndex", self._phrase_index), ("|FONT", self._fonts), ("|CONTEXT", self._contexts), ("|CTXOMAP", self._map), ("|TOMAP", self._tomap), ("|TTLBTREE", self._titles), ("|TopicId", self._topic_ids), ("|Rose", self._rose), ("|CATALOG", self._catalog), ("|VIOLA", self._viola), ("|Petra", self._petra), ("|TOPIC", self._topics)):
            if part in self.files:
                self.guarded(part, f, self.files[part])
        for part, data in self.files.items():
            if part.endswith("WBTREE"):
                self.guarded(part, self._keywords, part[1:-6], data)
            elif part.endswith("WDATA"):
                self.guarded(part, self._postings, part[1:-5], data)
            elif part.endswith("WMAP"):
                self.guarded(part, self._pages, part[1:-4], data)
            elif part.startswith("|CF"):
                self.guarded(part, self._config, part, data)
            elif part.endswith("!0"):
                self.add("annotation", int(part[:-2]), part, a=int(part[:-2]), text=decoded(data, self.encoding))
            elif part.endswith(".GRP"):
                self.guarded(part, self._groups, part, data)
            elif part.startswith("|bm") or part.startswith("bm"):
                self.guarded(part, self._pictures, part, data)
        return self.rows

    def _directory(self) -> None:
        r = Reader(self.data)
        magic, start, free, size = r.take("4i")
        if magic != MAGIC:
            raise ValueError(f"a container starts with {magic & 0xFFFFFFFF:#010x}")
        self.add("header", 0, a=start, b=size, text=str(free))
        tree = self._file(start)
        for k, (name, at) in enumerate(entries(tree, "z", "i")):
            name = name.decode("latin-1")
            try:
                self.files[name] = self._file(at)
            except (EOFError, ValueError) as e:
                self.add("error", k, name, text=str(e))
                continue
            self.add("file", k, name, a=at, b=len(self.files[name]), raw=self.files[name])

    def _file(self, at: int) -> bytes:
        r = Reader(self.data, at)
        _, used, _ = r.take("iiB")
        return r.bytes(used)

    def _system(self, data: bytes) -> None:
        r = Reader(data)
        magic, self.minor, major, made, self.flags = r.take("HHHlH")
        if magic != SYSTEM_MAGIC:
            raise ValueError("SYSTEM has no magic")
        self.add("system", 0, a=self.minor, b=major, text=str(made), raw=struct.pack("<H", self.flags))
        if self.minor <= 16:
            self.add("system_record", 0, "title", a=1, text=decoded(data[r.at :].split(b"\0")[0], self.encoding))
            return
        found = []
        while r.at + 4 <= len(data):
            kind, size = r.take("HH")
            found.append((kind, r.bytes(size)))
        for kind, body in found:  # the code page comes before any text is read; a character set beats a language
            if kind == 9 and len(body) >= 2:
                self.encoding = BY_LANGUAGE.get(struct.unpack_from("<H", body, len(body) - 2 if len(body) == 2 else 8 if len(body) >= 10 else 0)[0], self.encoding)
        for kind, body in found:
            if kind == 11 and body:
                self.encoding = BY_CHARSET.get(body[0], self.encoding)
        for k, (kind, body) in enumerate(found):
            number = struct.unpack_from("<i", body)[0] if kind == 3 and len(body) >= 4 else None
            text = decoded(body.split(b"\0")[0], self.encoding) if kind in (1, 2, 4, 8, 10, 18) else None
            self.add("system_record", k, SYSTEM_KINDS.get(kind, str(kind)), a=kind, b=number, text=text, raw=body)

    def _phrases(self, data: bytes) -> None:
        r = Reader(data)
        count, mark = r.take("HH")
        skip = 0
        if count == 0x0800:
            count, mark, skip = mark, r.take("H"), 30
        size = None
        if self.minor >= 16 or skip:
            size = r.take("i")
            r.bytes(skip)
        base = r.at
        offsets = [r.take("H") for _ in range(count + 1)]
        body = data[r.at :]
        if size is not None:
            body = codec.lz77(body, min(max(size, 0), codec.LIMIT))
        first = offsets[0]
        self.phrases = [body[a - first : b - first] for a, b in zip(offsets, offsets[1:], strict=False)]
        self.add("phrases", 0, "plain", a=count, b=base)

    def _phrase_index(self, data: bytes) -> None:
        r = Reader(data)
        _, count, _, size, packed, _, bits, _ = r.take("6lHH")
        lengths = codec.phrase_lengths(data[r.at :], count, bits & 15)
        image = self.files["|PhrImage"]
        if packed != size:
            image = codec.lz77(image, min(size, codec.LIMIT))
        at, self.phrases, self.hall = 0, [], True
        for n in lengths:
            self.phrases.append(image[at : at + n])
            at += n
        self.add("phrases", 0, "hall", a=count, b=size)

    def _fonts(self, data: bytes) -> None:
        r = Reader(data)
        faces, fonts, faces_at, fonts_at = r.take("4H")
        width = (fonts_at - faces_at) // max(faces, 1)
        for k in range(faces):
            self.add("face", k, text=decoded(data[faces_at + k * width : faces_at + (k + 1) * width].split(b"\0")[0], self.encoding))
        size = 11 if faces_at < 12 else 42
        for k in range(fonts):
            body = data[fonts_at + k * size : fonts_at + (k + 1) * size]
            if size == 11:
                bits, half, _, face = struct.unpack_from("<BBBH", body)
            else:
                face, height = struct.unpack_from("<h", body, 1)[0], struct.unpack_from("<l", body, 14)[0]
                weight, half = struct.unpack_from("<h", body, 30)[0], -2 * height
                bits = int(weight > 500) | bool(body[34]) << 1 | bool(body[35]) << 2 | bool(body[36]) << 3
            self.add("font", k, str(face), a=bits, b=half, raw=body)

    def _pairs(self, kind: str, data: bytes, form: str = "i") -> None:
        for k, (key, at) in enumerate(entries(data, form, "i")):
            self.add(kind, k, a=key & 0xFFFFFFFF, b=at)

    def _contexts(self, data: bytes) -> None:
        self._pairs("context", data)

    def _viola(self, data: bytes) -> None:
        self._pairs("window_of", data)

    def _texts(self, kind: str, data: bytes) -> None:
        for k, (at, text) in enumerate(entries(data, "i", "z")):
            self.add(kind, k, a=at, text=decoded(text, self.encoding))

    def _titles(self, data: bytes) -> None:
        self._texts("title", data)

    def _topic_ids(self, data: bytes) -> None:
        self._texts("topic_id", data)

    def _petra(self, data: bytes) -> None:
        self._texts("source_file", data)

    def _rose(self, data: bytes) -> None:
        for k, (key, macro, title) in enumerate(entries(data, "i", "z", "z")):
            self.add("macro", k, decoded(title, self.encoding), a=key & 0xFFFFFFFF, text=decoded(macro, self.encoding))

    def _map(self, data: bytes) -> None:
        r = Reader(data)
        for k in range(r.take("H")):
            key, at = r.take("ii")
            self.add("map_id", k, a=key, b=at)

    def _tomap(self, data: bytes) -> None:
        for k in range(len(data) // 4):
            self.add("topic_number", k, a=k + 16, b=struct.unpack_from("<I", data, 4 * k)[0])

    def _catalog(self, data: bytes) -> None:
        for k in range((len(data) - 40) // 4):
            self.add("catalog", k, b=struct.unpack_from("<I", data, 40 + 4 * k)[0])

    def _config(self, part: str, data: bytes) -> None:
        for k, macro in enumerate(m for m in data.split(b"\0") if m):
            self.add("config_macro", k, part, text=decoded(macro, self.encoding))

    def _groups(self, part: str, data: bytes) -> None:
        for k in range((len(data) - 12) // 12):
            low, high, group = struct.unpack_from("<III", data, 12 + 12 * k)
            self.add("group", k, str(group), a=low, b=high)

    def _keywords(self, kind: str, data: bytes) -> None:
        for k, (word, count, at) in enumerate(entries(data, "z", "h", "i")):
            self.add("keyword", k, kind, a=count, b=at, text=decoded(word, self.encoding))

    def _postings(self, kind: str, data: bytes) -> None:
        for k in range(len(data) // 4):
            self.add("posting", k, kind, a=4 * k, b=struct.unpack_from("<i", data, 4 * k)[0])

    def _pages(self, kind: str, data: bytes) -> None:
        r = Reader(data)
        for k in range(r.take("H")):
            number, page = r.take("iH")
            self.add("keyword_page", k, kind, a=number, b=page)

    def _pictures(self, part: str, data: bytes) -> None:
        if data[:2] == b"BM":
            self.add("picture", 0, part, a=0, b=0, text="bmp", raw=data)
            return
        r = Reader(data)
        magic, count = r.take("HH")
        for k, at in enumerate([r.take("I") for _ in range(count)]):
            one = Reader(data, at)
            kind, packing = one.take("BB")
            self.add("picture", k, part, a=kind, b=packing, text={0x506C: "lP", 0x706C: "lp"}.get(magic, "?"))

    def _topics(self, data: bytes) -> None:
        # before 3.1 a position counts 2,048 a block, from then on 0x4000, packed or not
        old = self.minor < 16
        block, unit = 2048 if old or self.flags == 8 else 4096, 2048 if old else 0x4000
        packed = not old and self.flags in (4, 8)
        parts = [data[at + 12 : at + block] for at in range(0, len(data), block)]
        parts = [codec.lz77(p, unit) for p in parts] if packed else parts
        starts, whole = [0], b"".join(parts)
        for p in parts:
            starts.append(starts[-1] + len(p))
        position, number, order, text, seen = 12, -1, 0, 0, set()
        base_block = 0
        while position >= 12 and (position - 12) // unit < len(parts) and position not in seen:
            seen.add(position)
            at = starts[(position - 12) // unit] + (position - 12) % unit
            if at >= len(whole) - 20:
                break
            r = Reader(whole, at)
            size, length2, _, after, length1, kind = r.take("5iB")
            if size < 21 or not 21 <= length1 <= size:
                break
            body1 = Reader(r.bytes(length1 - 21))
            body2 = self._second(r.bytes(min(size - length1, len(whole) - r.at)), length2)
            if (position - 12) // unit != base_block:
                base_block, text = (position - 12) // unit, 0
            if kind == 2:
                number += 1
                strings = body2.split(b"\0")
                before, behind = struct.unpack_from("<ii", body1.data, 4) if len(body1.data) >= 12 else (-1, -1)
                self.add("topic", number, decoded(strings[0], self.encoding), a=base_block * 32768 + text, raw=struct.pack("<ii", before, behind))
                for k, macro in enumerate(m for m in strings[1:] if m):
                    self.add("topic_macro", k, a=number, text=decoded(macro, self.encoding))
            elif kind in (1, 0x20, 0x23):
                text += self._display(number, kind, body1, body2)
            order += 1
            if after in (0, -1):
                break
            position = position + after if old else after

    def _second(self, data: bytes, length: int) -> bytes:
        if length <= len(data) or self.phrases is None:
            return data[:length] if length >= 0 else data
        expand = codec.hall_expand if self.hall else codec.phrases_expand
        return expand(data, self.phrases, min(length, codec.LIMIT))

    def _display(self, number: int, kind: int, r: Reader, strings: bytes) -> int:
        """Spans and links of one text or table record; returns how many characters it counts."""
        r.signed_long()
        length = r.unsigned_word() if kind != 1 else len(strings)
        if kind == 0x23:
            columns, shape = r.take("BB")
            if shape in (0, 2):
                r.take("h")
            r.bytes(4 * columns)
        texts = Reader(strings)
        font, link, column = -1, None, 0
        while True:
            if kind == 0x23:
                column = r.take("h")
                if column == -1:
                    break
                r.bytes(3)
            self._paragraph(number, r)
            while True:
                piece = texts.zero_ended() if texts.at < len(strings) else b""
                if piece:
                    self.add("span", len(self.rows), link, a=number, b=font, text=decoded(piece, self.encoding), raw=struct.pack("<h", column))
                if r.at >= len(r.data):
                    return length
                op = r.take("B")
                if op == 0xFF:
                    break
                if op == 0x80:
                    font = r.take("h")
                elif op in (0x81, 0x82, 0x83, 0x8B, 0x8C):
                    mark = {0x81: "\n", 0x82: "\n\n", 0x83: "\t", 0x8B: " ", 0x8C: "-"}[op]
                    self.add("span", len(self.rows), link, a=number, b=font, text=mark, raw=struct.pack("<h", column))
                elif op == 0x89:
                    link = None
                elif op == 0x20:
                    r.take("i")
                elif op == 0x21:
                    r.take("h")
                elif op in (0x86, 0x87, 0x88):
                    shape = r.take("B")
                    size = r.signed_long()
                    if shape == 0x22:
                        r.unsigned_word()
                    body = r.bytes(size)
                    picture = struct.unpack_from("<hh", body) if shape != 5 and len(body) >= 4 else (1, 0)
                    if picture[0] == 0:
                        self.add("image", len(self.rows), f"bm{picture[1]}", a=number, text={0x86: "current", 0x87: "left", 0x88: "right"}[op])
                elif op in (0xC8, 0xCC):
                    link = "macro:" + decoded(r.bytes(r.take("h")).split(b"\0")[0], self.encoding)
                    self.add("link", len(self.rows), link, a=number)
                elif 0xE0 <= op <= 0xE7:
                    link = f"{'topic' if op & 1 else 'popup'}:{r.take('I'):08X}"
                    self.add("link", len(self.rows), link, a=number)
                elif op in (0xEA, 0xEB, 0xEE, 0xEF):
                    body = Reader(r.bytes(r.take("h")))
                    shape, target = body.take("BI")
                    window = str(body.take("B")) if shape == 1 else ""
                    file = decoded(body.zero_ended(), self.encoding) if shape in (4, 6) else ""
                    window = decoded(body.zero_ended(), self.encoding) if shape == 6 else window
                    link = f"{'topic' if op >= 0xEE else 'popup'}:{target:08X}>{window}@{file}"
                    self.add("link", len(self.rows), link, a=number)
                else:
                    raise ValueError(f"unknown text command {op:#04x}")
            if kind != 0x23:
                break
        return length

    def _paragraph(self, number: int, r: Reader) -> None:
        r.bytes(4)
        bits = r.take("H")
        values = [r.signed_long() if k == 0 else r.signed_word() if bits >> k & 1 else None for k in range(7) if bits >> k & 1 or k]
        values = [v for v in values if v is not None]
        if bits >> 8 & 1:
            r.bytes(3)
        if bits >> 9 & 1:
            for _ in range(r.signed_word()):
                if r.unsigned_word() & 0x4000:
                    r.unsigned_word()
        align = "right" if bits >> 10 & 1 else "center" if bits >> 11 & 1 else "left"
        self.add("paragraph", len(self.rows), align, a=number, b=bits, text=",".join(map(str, values)))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "kind", "ord", "key", "a", "b", "text", "raw"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = Container(name, data or b"").records()
            for k in range(0, len(rows), 10_000):
                columns = zip(*rows[k : k + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def decode(files: DataFrame) -> DataFrame:
    """The records of rows (path, content)."""
    return files.select("path", "content").mapInArrow(_decode, RECORD)


def scan(spark: SparkSession, path: str, glob: str = "*.{hlp,mvb,gid,ann,HLP,MVB,GID,ANN}") -> DataFrame:
    """The records of all containers under a path, folders within included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return decode(files)


#: Typed views: kind to the names of key, a, b, text and raw (None: not in the view).
VIEWS = {
    "header": (None, "directory_start", "size", None, None),
    "file": ("name", "offset", "used", None, "content"),
    "system_record": ("type", "code", "number", "text", "payload"),
    "face": (None, None, None, "name", None),
    "font": ("face", "attributes", "half_points", None, None),
    "context": (None, "hash", "topic_offset", None, None),
    "map_id": (None, "map_id", "topic_offset", None, None),
    "topic_number": (None, "topic_number", "position", None, None),
    "catalog": (None, None, "topic_offset", None, None),
    "window_of": (None, "topic_offset", "window", None, None),
    "title": (None, "topic_offset", None, "title", None),
    "topic_id": (None, "topic_offset", None, "name", None),
    "source_file": (None, "topic_offset", None, "name", None),
    "macro": ("title", "hash", None, "macro", None),
    "config_macro": ("config", None, None, "macro", None),
    "keyword": ("type", "count", "data_offset", "keyword", None),
    "posting": ("type", "data_offset", "topic_offset", None, None),
    "keyword_page": ("type", "keyword_no", "page", None, None),
    "group": ("group_no", "low", "high", None, None),
    "annotation": (None, "topic_offset", None, "text", None),
    "picture": ("name", "type", "packing", "container", "content"),
    "topic": ("title", "topic_offset", None, None, "browse"),
    "topic_macro": (None, "topic", None, "macro", None),
    "span": ("link", "topic", "font", "text", None),
    "link": ("target", "topic", None, None, None),
    "image": ("name", "topic", None, "align", None),
    "paragraph": ("align", "topic", "bits", "values", None),
    "error": ("component", None, None, "error", None),
}


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """A view of each kind of record, keyed by file and ord."""
    out = {}
    for kind, names in VIEWS.items():
        columns = [F.col(c).alias(n) for c, n in zip(("key", "a", "b", "text", "raw"), names, strict=True) if n]
        out[kind] = records.where(F.col("kind") == kind).select("file", "ord", *columns)
    return out


def topic_texts(records: DataFrame) -> DataFrame:
    """Each topic's plain text: its spans in order."""
    spans = records.where("kind = 'span'").groupBy("file", F.col("a").alias("topic"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return spans.agg(text.alias("text"))
