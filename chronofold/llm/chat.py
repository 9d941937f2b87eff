"""Chat formatting by schema fingerprint.

A record is a JSON object. Of the declared layouts whose required paths it has, the one that explains most of its
paths is taken; the paths it shares with that layout are hashed, and the hash picks a mapping, which is data, not code: where turns lie and which fields
hold role and text, or which fields make up single turns. The result is one
canonical list of turns, written with one template. Control strings inside roles and
texts, the template's own and those of other chat formats, are escaped so that
reading back gives the very input.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: The template's marks and control strings of other public chat formats.
CONTROL = (TURN, SAYS, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "</s>", "<s>")
ESCAPE = "\\"
_control = re.compile("|".join(map(re.escape, CONTROL)))
_token = re.compile(r"\\.|" + "|".join(map(re.escape, (TURN, SAYS, END))), re.DOTALL)


@dataclass(frozen=True)
class Layout:
    """``turns``: path of the list of turns, ``role`` and ``text`` its fields; or ``singles``: (field, role) in order, fields of one role joined by a blank line."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    singles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def required(self) -> set[str]:
        return self.paths() - set(self.optional)

    def own(self, paths: set[str]) -> set[str]:
        """The paths of a record that belong to this layout; none if a required one is missing."""
        if self.turns and f"{self.turns}[]" in paths and not paths & self.paths():
            return paths & {f"{self.turns}[]", *self.optional}
        return paths & (self.paths() | set(self.optional)) if self.required() <= paths else set()

    def paths(self) -> set[str]:
        return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"} if self.turns else {f for f, _ in self.singles}


_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
LAYOUTS = (
    Layout("turns", "turns", "role", "text", (("system", "system"),), ("system",)),
    Layout("messages", "messages", "role", "content", (("system", "system"),), ("system",), roles=_ALIASES),
    Layout("from-value", "conversations", "from", "value", (("system", "system"),), ("system",), roles=_ALIASES),
    Layout("prompt-completion", singles=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Layout("prompt-response", singles=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Layout("instruction", singles=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Layout("question-answer", singles=(("system", "system"), ("context", "user"), ("question", "user"), ("answer", "assistant")), optional=("system", "context")),
)


def paths_of(value, at: str = "") -> set[str]:
    """Nested field paths down to what is neither object nor list; list items share ``[]``."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Layout by fingerprint, with and without each optional field, and with an empty list of turns."""
    found: dict[str, Layout] = {}
    for x in layouts:
        for least in [x.required()] + ([{f"{x.turns}[]"}] if x.turns else []):
            for n in range(len(x.optional) + 1):
                for some in itertools.combinations(x.optional, n):
                    found.setdefault(fingerprint(least | set(some)), x)
    return found


BY_FINGERPRINT = registry()


def layout_of(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout that holds most of the paths, the first of several."""
    own = max((x.own(paths) for x in layouts), key=len)
    return BY_FINGERPRINT.get(fingerprint(own))


def reject_reason(record: str | None) -> str | None:
    """Why ``canonical`` finds no layout; None if it finds one."""
    if record is None:
        return "null"
    try:
        value = json.loads(record)
    except ValueError:
        return "broken JSON"
    if not isinstance(value, dict):
        return "no object"
    return "unknown layout" if layout_of(paths_of(value)) is None else None


def canonical(record: str | None) -> tuple[str, list[tuple[str, str]]]:
    """(layout name, turns). Null, broken JSON and unknown layouts give ("", []); lone surrogates become ?."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        return "", []
    if not isinstance(value, dict):
        return "", []
    layout = layout_of(paths_of(value))
    if layout is None:
        return "", []

    def string(x) -> str:
        x = "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        return x.encode("utf-8", "replace").decode()

    turns: list[tuple[str, str]] = []
    for name, role in layout.singles:
        if name in value and value[name] not in (None, ""):
            if turns and turns[-1][0] == role:
                turns[-1] = (role, f"{turns[-1][1]}\n\n{string(value[name])}")
            else:
                turns.append((role, string(value[name])))
    if layout.turns:
        for x in value[layout.turns] or []:
            x = x if isinstance(x, dict) else {layout.text: x}
            role = string(x.get(layout.role))
            turns.append((layout.roles.get(role, role), string(x.get(layout.text))))
    return layout.name, turns


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], learn: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans under the loss mask in code points, ends exclusive)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role in learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    turns, role, start = [], "", 0
    for m in _token.finditer(formatted):
        if m[0] == TURN:
            start = m.end()
        elif m[0] == SAYS:
            role, start = unescape(formatted[start : m.start()]), m.end()
        elif m[0] == END:
            turns.append((role, unescape(formatted[start : m.start()])))
    return turns


FORMATTED = "layout string, formatted string, mask array<struct<start:long,end:long>>"


def _format(records: pd.Series) -> pd.DataFrame:
    rows = []
    for x in records:
        name, turns = canonical(x)
        text, spans = render(turns)
        rows.append((name, text, [{"start": a, "end": b} for a, b in spans]))
    return pd.DataFrame(rows, columns=["layout", "formatted", "mask"])


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(formatted: pd.Series, mask: pd.Series) -> pd.DataFrame:
    rows = []
    for text, spans in zip(formatted, mask, strict=True):
        turns = read_back(text)
        learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
        whole = "".join(f"{role}\n{said}\n" for role, said in turns)
        rows.append((len(turns), _sha(whole), len(learned), _sha(learned), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def format_chats(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with layout, formatted and mask in place of the JSON column.

    A null record, broken JSON or an unknown layout gives layout "" and an empty text. Fields
    beyond a layout's own don't matter, in whatever order they stand.
    """
    rest = [F.col(f"`{c}`") for c in records.columns if c not in (record_col, "layout", "formatted", "mask")]
    return records.withColumn("_f", F.pandas_udf(_format, FORMATTED)(F.col(f"`{record_col}`"))).select(*rest, "_f.layout", "_f.formatted", "_f.mask")


def rejects(records: DataFrame, record_col: str = "record") -> tuple[DataFrame, DataFrame]:
    """(the rows of ``records`` without a layout, with ``reason``; the number n of them by reason)."""
    reason = F.pandas_udf(lambda x: x.map(reject_reason, na_action=None), "string")(F.col(f"`{record_col}`"))
    out = records.withColumn("reason", reason).where("reason is not null")
    return out, out.groupBy("reason").agg(F.count("*").alias("n"))


def digests(formatted: Column | str = "formatted", mask: Column | str = "mask") -> Column:
    """Struct of what reading back gives; see ``DIGEST``."""
    return F.pandas_udf(_digest, DIGEST)(formatted, mask)


def pack(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, record) from rows (id, turn, role, text) in order of turn, role and text; null role and text: empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select(id_col, F.to_json(F.struct(turns.alias("turns"))).alias("record"))
