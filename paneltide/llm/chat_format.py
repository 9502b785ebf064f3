"""Canonical chat turns from records of many layouts, and a training format that can be read back.

A record is JSON. The set of its nested field paths is hashed, and the hash selects a declarative
mapping to turns; a layout is known by its paths alone, so a mapping lists the paths that it
requires and those that it takes where they are there. Where no mapping has the hash of all paths,
each mapping's required paths are hashed out of the record's: the one that requires most of those
whose hash agrees is taken, and all else (a source's own metadata) is passed over. Layouts that are
unknown even so give no turns and are reported by their hash.

The template writes each turn as `### Role: text</turn>` and a line end. In texts and roles the
escape character, the turn marks and the colon behind a role are replaced by two-character codes,
so no text can open or close a turn, and all can be undone.

Defined results: a null role or text is empty; rows of one conversation are in order of turn, then
role, then text; a record that is no JSON object, is null, or is nested too deeply to be parsed has
no turns; a text in parts is their texts, a line each; repeated records each give their result.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm.common import map_texts

Turn = tuple[str, str]


def field_paths(value) -> set[str]:
    """Paths of all leaves: .name for a field, [] for what a list holds."""
    found, todo = set(), [("", value)]
    while todo:
        prefix, x = todo.pop()
        if isinstance(x, dict) and x:
            todo += [(f"{prefix}.{k}", v) for k, v in x.items()]
        elif isinstance(x, list) and x:
            todo += [(prefix + "[]", v) for v in x]
        else:
            found.add(prefix + ("{}" if isinstance(x, dict) else "[]" if isinstance(x, list) else ""))
    return found


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Either single fields, each a turn of one role, or a list of turns with its role and text fields."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    #: Fields whose text is put behind that of another, after an empty line.
    joined: dict[str, str] = field(default_factory=dict, hash=False)
    #: A field that is a turn of its own role before the list of turns, where the record has it.
    lead: str = "system"

    def paths(self) -> set[str]:
        """What a record must have."""
        if self.turns:
            return {f".{self.turns}[].{self.role}", f".{self.turns}[].{self.text}"}
        return {f".{name}" for name, _ in self.fields} | {f".{x}" for x in self.joined}

    def of(self, paths: set[str]) -> set[str]:
        """The required paths that a record's paths hold, or lead on from; an empty list of turns has those of a turn."""
        if self.turns and f".{self.turns}[]" in paths:
            return self.paths()
        return {q for q in self.paths() if q in paths or any(p.startswith((q + ".", q + "[", q + "{")) for p in paths)}

    def apply(self, record: dict) -> list[Turn]:
        if self.turns:
            said = [t for t in record[self.turns] if isinstance(t, dict)]
            made = [(self.roles.get(r := as_text(t.get(self.role)), r), as_text(t.get(self.text))) for t in said]
            return [(self.lead, as_text(record[self.lead])), *made] if record.get(self.lead) is not None else made
        made = []
        for name, role in self.fields:
            parts = [as_text(record.get(name)), *(as_text(record.get(x)) for x, behind in self.joined.items() if behind == name)]
            made.append((role, "\n\n".join(p for i, p in enumerate(parts) if p or not i)))
        return made


def as_text(value) -> str:
    """A text, a list of texts or of parts with a text, or the JSON of anything else."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        parts = [x.get("text") if isinstance(x, dict) else x for x in value]
        if parts and all(isinstance(x, str) for x in parts):
            return "\n".join(parts)
    return json.dumps(value, ensure_ascii=False)


SPEAKERS = {"human": "user", "gpt": "assistant"}
MAPPINGS = [
    Mapping("prompt-response", (("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt-completion", (("prompt", "user"), ("completion", "assistant"))),
    Mapping("question-answer", (("question", "user"), ("answer", "assistant"))),
    Mapping("system-prompt-response", (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("instruction", (("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction-input", (("instruction", "user"), ("output", "assistant")), joined={"input": "instruction"}),
    Mapping("system-instruction", (("system", "system"), ("instruction", "user"), ("output", "assistant"))),
    Mapping("system-instruction-input", (("system", "system"), ("instruction", "user"), ("output", "assistant")), joined={"input": "instruction"}),
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("conversations", turns="conversations", role="from", text="value", roles=SPEAKERS),
    Mapping("dialogue", turns="turns", role="speaker", text="text", roles=SPEAKERS),
]
REGISTRY = {fingerprint(m.paths()): m for m in MAPPINGS}


def chosen(paths: set[str], registry: dict[str, Mapping]) -> Mapping | None:
    """The mapping whose hash the paths have, or the one that requires most of those whose hash its own paths have."""
    if exact := registry.get(fingerprint(paths)):
        return exact
    fits = [m for mark, m in registry.items() if fingerprint(m.of(paths)) == mark]
    return max(fits, key=lambda m: (bool(m.turns), len(m.paths())), default=None)


def canonical(record: str | None, registry: dict[str, Mapping] | None = None) -> tuple[str, str, list[Turn]]:
    """(fingerprint, name of the mapping or empty, turns) of a record."""
    try:
        value = json.loads(record) if record else None
        if not isinstance(value, dict):
            return "", "", []
        paths = field_paths(value)
        found = chosen(paths, REGISTRY if registry is None else registry)
        return fingerprint(paths), found.name if found else "", found.apply(value) if found else []
    except (ValueError, RecursionError):
        return "", "", []


SHOWN = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMED = {v: k for k, v in SHOWN.items()}
OPEN, CLOSE = "### ", "</turn>\n"
CODES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
UNDO = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":"}
TURN = re.compile(r"### ((?:[^:\\]|\\.)*): ((?:.)*?)</turn>\n", re.S)


def escaped(text: str) -> str:
    for plain, code in CODES:
        text = text.replace(plain, code)
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: UNDO[m[1]], text, flags=re.S) if "\\" in text else text


def formatted(turns: list[Turn], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The training text and the loss mask: ranges (code points) of the learnt role's texts."""
    out, mask, at = [], [], 0
    for role, text in turns:
        shown = SHOWN.get(role) or "=" + escaped(role).replace(":", "\\c")
        head, body = f"{OPEN}{shown}: ", escaped(text)
        at += len(head)
        if role == learn:
            mask.append((at, at + len(body)))
        out += (head, body, CLOSE)
        at += len(body) + len(CLOSE)
    return "".join(out), mask


def read_back(text: str) -> list[Turn]:
    """The turns of a training text."""
    return [(NAMED.get(m[1]) or unescaped(m[1][1:]), unescaped(m[2])) for m in TURN.finditer(text)]


def format_records(df: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """id, layout hash, mapping, formatted text and loss mask of every record."""

    def kernel(ids, records):
        out = {k: [] for k in ("layout", "mapping", "formatted", "loss_mask")}
        for record in records:
            layout, name, turns = canonical(record)
            text, mask = formatted(turns)
            for k, v in zip(out, (layout, name, text, [{"start": a, "end": b} for a, b in mask])):
                out[k].append(v)
        return {"id": ids} | out

    schema = "id long, layout string, mapping string, formatted string, loss_mask array<struct<start: int, end: int>>"
    return map_texts(df.selectExpr(f"`{id_col}` AS id", f"`{record_col}` AS record"), kernel, schema, ["id", "record"])


def unmapped(made: DataFrame) -> DataFrame:
    """Layouts of format_records() that no mapping knows, and how many records have them."""
    return made.where("mapping = ''").groupBy("layout").agg(F.count("*").alias("n"))


def digests(made: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them and their masks."""

    def kernel(ids, mappings, masks, texts):
        out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for mask, text in zip(masks, texts):
            turns = read_back(text)
            loss = "".join(unescaped(text[m["start"] : m["end"]]) for m in mask)
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            sums = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, loss)]
            for k, v in zip(out, (len(turns), sums[0], len(loss), sums[1], len(text))):
                out[k].append(v)
        return {"conv_id": ids, "mapping": mappings} | out

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, mapping string"
    return map_texts(made, kernel, schema, ["id", "mapping", "loss_mask", "formatted"])


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, record): one JSON record per conversation.

    Short exchanges take the flat layouts, the others a list of messages in one of two spellings,
    as in a corpus that was gathered from several sources.
    """
    said = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = rows.groupBy("conv_id").agg(said.alias("said")).withColumn("roles", F.col("said.role"))
    text = lambda i: F.col("said")[i]["text"]
    is_ = lambda *roles: F.col("roles") == F.array(*map(F.lit, roles))
    usual = F.forall("roles", lambda r: r.isin("system", "user", "assistant"))
    speaker = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    record = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(usual & (F.pmod("conv_id", F.lit(2)) == 0), F.to_json(F.struct(F.transform("said", lambda t: F.struct(speaker(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def tricky(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def format_conversations(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Digests of all conversations and of the tricky one."""
    rows = rows.select("conv_id", "turn", "role", "text").unionByName(tricky(spark))
    return digests(format_records(as_records(rows), "conv_id", "record"))
