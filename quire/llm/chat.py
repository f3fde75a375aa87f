"""Chat formatting from typed content parts.

A turn is a text, or a list of parts: text, image, audio and document, documents with parts of their
own. A visitor walks the parts and writes the turn's body: texts escaped, a placeholder for each
attachment in the order met; what the placeholder stands for (kind, reference, the source's own
wording, the tokens it expands to) goes to a list in the same order, so that the k-th placeholder is
the k-th entry. A template's control strings mark turns; inside texts a backslash after the first
sign of each, and one more where there are some already, makes them plain, and taking one away
restores the text exactly.

Rows are turns, dealt out by ranges of conversation and turn, so that one conversation may be as
long as it likes: it is formatted by many tasks, and kept as chunks of whole turns. A chunk holds
at most CHUNK characters, or one turn. The loss mask lists, per chunk, the spans of the bodies of
learned roles. Reading back needs a second shuffle only for conversations that are in more chunks
than one or at the edge of a task's range.

A null text, or a null list, is an empty body; a null role is a role of no letters; null
conversation ids are one conversation; null turns come first. Turns that tie are ordered by role,
then by a hash of the body, so repeated rows are turns each. Parts of other kinds count as text.
Columns other than those named are ignored, whatever their names. No rows give no rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, materialise, release

#: Characters of formatted text after which a chunk ends at the next turn.
CHUNK = 1 << 20
ATTACHMENTS = "array<struct<kind: string, ref: string, source: string, tokens: long>>"
CHUNKS = f"conv_id long, turn long, role string, mark long, seq long, whole boolean, n_turns long, formatted string, loss array<struct<start: long, stop: long>>, attachments {ATTACHMENTS}, attached_tokens long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attached_tokens long"
#: Endings of references in Markdown, by what they name.
ENDINGS = {"image": "png|jpg|jpeg|gif|webp|bmp", "audio": "mp3|wav|ogg|flac", "document": "pdf|docx|epub"}
_LINK = re.compile(r"!\[[^\[\]\n]*\]\(([^()\x00-\x20]+\.(?:" + "|".join(f"(?P<{k}>(?i:{v}))" for k, v in ENDINGS.items()) + r"))\)")


@dataclass(frozen=True)
class Template:
    """Control strings; each begins with a sign that none holds elsewhere, so that two can't overlap."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    #: Before the name of any other role, after it, and after its body.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    marks: dict[str, str] = field(default_factory=lambda: {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"})
    #: After the parts inside a document.
    close: str = "[/DOC]"
    pad: str = " "
    learned: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        controls = self.controls
        firsts = {c[0] for c in controls}
        if len(set(controls)) != len(controls) or any(not c[1:] or "\\" in c or firsts & set(c[1:]) for c in controls) or firsts & set(self.pad):
            raise ValueError("control strings need first signs that no control string holds elsewhere, and no backslash")

    @property
    def controls(self) -> list[str]:
        return [c for pair in self.roles.values() for c in pair] + [*self.other, *self.marks.values(), self.close]


class Codec:
    """Writes and reads turns by a template."""

    def __init__(self, template: Template) -> None:
        self.template = template
        longest = sorted(template.controls, key=len, reverse=True)
        self._plain = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in longest))
        self._escaped = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in longest))
        self._control = re.compile("|".join(re.escape(c) for c in longest))
        self._openings = {a: (role, b) for role, (a, b) in template.roles.items()}
        self._marks = set(template.marks.values())

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def restore(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def turn(self, role: str, body: str) -> tuple[str, int, int]:
        """The formatted turn, and where its body is."""
        t = self.template
        if role in t.roles:
            before, after = t.roles[role]
        else:
            before, after = t.other[0] + self.escape(role) + t.other[1], t.other[2]
        head = before + t.pad
        return head + body + t.pad + after, len(head), len(head) + len(body)

    def turns(self, formatted: str) -> Iterator[tuple[str, int, int]]:
        """Role and body's span of each turn of a formatted text."""
        t, at = self.template, 0
        while at < len(formatted):
            opening = self._control.match(formatted, at)
            at = opening.end()
            if opening[0] == t.other[0]:
                sep = formatted.index(t.other[1], at)
                role, closing, at = self.restore(formatted[at:sep]), t.other[2], sep + len(t.other[1])
            else:
                role, closing = self._openings[opening[0]]
            end = formatted.index(closing, at)
            yield role, at + len(t.pad), end - len(t.pad)
            at = end + len(closing)

    def text(self, body: str, attachments: Iterator[dict]) -> str:
        """A body's text: restored, and each placeholder in its source's wording."""
        out, at = [], 0
        for m in self._control.finditer(body):
            out.append(self.restore(body[at : m.start()]))
            if m[0] in self._marks:
                out.append(next(attachments)["source"] or "")
            at = m.end()
        return "".join(out) + self.restore(body[at:])

    def placeholders(self, body: str) -> int:
        return sum(m[0] in self._marks for m in self._control.finditer(body))


@dataclass(frozen=True)
class Sizes:
    """Tokens that an attachment expands to; defaults where a part does not say how large it is."""

    patch: int = 28
    image: int = 256
    per_second: float = 25.0
    audio: int = 750
    page: int = 512


class Visitor:
    """Walks the parts of one turn and flattens them."""

    def __init__(self, codec: Codec, sizes: Sizes) -> None:
        self.codec, self.sizes = codec, sizes
        self.body: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(self.codec.escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: float) -> None:
        self.body.append(self.codec.template.marks[kind])
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "source": part.get("text"), "tokens": math.ceil(tokens)})

    def visit_image(self, part: dict) -> None:
        wide, high, p = part.get("width"), part.get("height"), self.sizes.patch
        self._attach("image", part, -(-wide // p) * -(-high // p) if wide and high else self.sizes.image)

    def visit_audio(self, part: dict) -> None:
        length = part.get("seconds")
        self._attach("audio", part, length * self.sizes.per_second if length else self.sizes.audio)

    def visit_document(self, part: dict) -> None:
        inner = part.get("parts")
        pages = part.get("pages")
        self._attach("document", part, (pages or (0 if inner else 1)) * self.sizes.page)
        if inner:
            for each in inner:
                self.visit(each)
            self.body.append(self.codec.template.close)


def parts_of(text: str) -> list[dict]:
    """A plain text as parts: Markdown links to images, recordings and documents are attachments, in their own wording."""
    out, at = [], 0
    for m in _LINK.finditer(text):
        out += [{"type": "text", "text": text[at : m.start()]}, {"type": next(k for k in ENDINGS if m[k]), "ref": m[1], "text": m[0]}]
        at = m.end()
    return [*out, {"type": "text", "text": text[at:]}]


def _assembled(rows: Iterator[tuple], codec: Codec, sizes: Sizes, limit: int) -> Iterator[dict]:
    """Chunks of sorted turns; the first and the last conversation of a task, and what is in several chunks, are not whole."""
    held: dict | None = None
    first, seq = True, 0
    for conv, turn, role, mark, content in rows:
        if held is not None and (held["conv_id"] != conv or held["size"] > limit):
            if held["conv_id"] == conv:
                held["whole"] = False
            yield held
            follows = held["conv_id"] == conv
            first, held = False, None
        else:
            follows = False
        if held is None:
            held = {"conv_id": conv, "turn": turn, "role": role, "mark": mark, "seq": seq, "whole": not first and not follows, "n_turns": 0, "pieces": [], "size": 0, "loss": [], "attachments": []}
            seq += 1
        visitor = Visitor(codec, sizes)
        for part in parts_of(content or "") if content is None or isinstance(content, str) else content:
            visitor.visit(part)
        piece, start, stop = codec.turn(role or "", "".join(visitor.body))
        if (role or "") in codec.template.learned:
            held["loss"].append({"start": held["size"] + start, "stop": held["size"] + stop})
        held["pieces"].append(piece)
        held["size"] += len(piece)
        held["n_turns"] += 1
        held["attachments"] += visitor.attachments
    if held is not None:
        held["whole"] = False
        yield held


def _finished(chunk: dict) -> dict:
    return chunk | {"formatted": "".join(chunk["pieces"]), "attached_tokens": sum(a["tokens"] for a in chunk["attachments"])}


def _batched(rows: Iterator[dict], schema: pa.Schema, size_of, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append({k: row[k] for k in schema.names})
        size += size_of(row)
        if size > limit or len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
    release()


_ATT = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("source", pa.string()), ("tokens", pa.int64())]))
_CHUNK_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("mark", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("attachments", _ATT), ("attached_tokens", pa.int64())])
_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attached_tokens", pa.int64())])


def format_chats(df: DataFrame, content_col: str = "text", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", template: Template | None = None, sizes: Sizes | None = None, chunk: int = CHUNK) -> DataFrame:
    """Chunks of formatted conversations with loss spans and attachments; content is a text or an array of parts (type, text, ref, width, height, seconds, pages, parts)."""
    spark = df.sparkSession
    bounded_arrow(spark)
    template, sizes = template or Template(), sizes or Sizes()
    content = df[content_col]
    rows = df.select(df[conv_col].cast("long").alias("conv_id"), df[turn_col].cast("long").alias("turn"), df[role_col].cast("string").alias("role"), F.xxhash64(content.cast("string") if df.schema[content_col].dataType.simpleString() == "string" else F.to_json(content)).alias("mark"), content.alias("content"))
    keys = ["conv_id", "turn", "role", "mark"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(template)
        turns = (row for b in batches for at in range(0, b.num_rows, 256) for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)))
        yield from _batched(map(_finished, _assembled(turns, codec, sizes, chunk)), _CHUNK_SCHEMA, lambda r: len(r["formatted"]))

    return ordered.mapInArrow(run, CHUNKS)


def _folded(rows: Iterator[dict], codec: Codec) -> Iterator[dict]:
    """One digest a conversation of chunks in order; holds a chunk and two hashes."""
    now: dict | None = None
    for row in rows:
        if now is None or now["conv_id"] != row["conv_id"]:
            if now is not None:
                yield _closed(now)
            now = {"conv_id": row["conv_id"], "n_turns": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "formatted_chars": 0, "n_attachments": 0, "attached_tokens": 0}
        formatted, attachments, spans = row["formatted"], iter(row["attachments"]), {(s["start"], s["stop"]) for s in row["loss"]}
        for role, start, stop in codec.turns(formatted):
            text = codec.text(formatted[start:stop], attachments)
            now["turns"].update(f"{role}\n{text}\n".encode())
            now["n_turns"] += 1
            if (start, stop) in spans:
                now["loss"].update(text.encode())
                now["loss_chars"] += len(text)
        now["formatted_chars"] += len(formatted)
        now["n_attachments"] += len(row["attachments"])
        now["attached_tokens"] += row["attached_tokens"]
    if now is not None:
        yield _closed(now)


def _closed(now: dict) -> dict:
    return now | {"turns_sha256": now["turns"].hexdigest(), "loss_sha256": now["loss"].hexdigest()}


def read_back(chunks: DataFrame, template: Template | None = None) -> DataFrame:
    """A row a conversation, from written chunks: digests of its turns and of the text under the loss mask, both restored."""
    template = template or Template()
    chunks = chunks.select("conv_id", "turn", "role", "mark", "seq", "whole", "formatted", "loss", "attachments", "attached_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(template)
        rows = (row for b in batches for at in range(0, b.num_rows, 64) for row in b.slice(at, 64).to_pylist())
        yield from _batched(_folded(rows, codec), _DIGEST_SCHEMA, lambda r: 256)

    parted = chunks.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark", "seq")
    return chunks.where("whole").mapInArrow(run, DIGESTS).unionByName(parted.mapInArrow(run, DIGESTS))


def conversations(df: DataFrame, template: Template | None = None) -> DataFrame:
    """Formats the conversations, writes them, and reads the written chunks back."""
    return read_back(materialise(format_chats(df, template=template), "chats"), template)
