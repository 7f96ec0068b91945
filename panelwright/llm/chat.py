"""Chat records of any known layout -> canonical turns -> one marked, reversible training text per conversation.

Layouts are told apart by a fingerprint: the SHA-256 of the sorted nested field paths of a record, restricted to paths
that some mapping names. A mapping is declarative: the paths it needs, those it may have, and where role and text come
from. All steps are column expressions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TURNS = "array<struct<role:string,text:string>>"
#: Role names of common layouts and their canonical names.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """turns: (role, path) for fixed roles in order; or each: (array, role field, text field); exact: roles as they are."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    exact: bool = False
    paths: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "paths", frozenset((*self.required, *self.optional)))

    def fingerprints(self) -> list[str]:
        """One for each set of paths that this mapping accepts."""
        return [fingerprint_of((*self.required, *more)) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]


def fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


#: Field names of common layouts.
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "turn", "role", "text")),
    Mapping("turns", ("turns[].role", "turns[].text"), each=("turns", "role", "text"), exact=True),
    Mapping("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("system",), (("system", "system"),), ("conversations", "from", "value")),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction\n\ninput"), ("assistant", "output"))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), (), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), ("context",), (("user", "context\n\nquestion"), ("assistant", "answer"))),
    Mapping("nested_prompt", ("prompt.text", "completion.text"), (), (("user", "prompt.text"), ("assistant", "completion.text"))),
)
VOCABULARY = sorted(frozenset().union(*(m.paths for m in MAPPINGS)))
BY_FINGERPRINT = {f: m.name for m in MAPPINGS for f in m.fingerprints()}


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a typed record, in the form that `paths` gives for a JSON one."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


def paths(record: Column) -> Column:
    """Leaf paths of a variant, by a fold over the words of its schema; null if it isn't an object."""
    schema = F.schema_of_variant(record)
    name = r"(?:`(?:[^`]|``)*`|[A-Za-z_][A-Za-z0-9_]*)"
    # a mark in front tells field names from types
    words = F.regexp_extract_all(F.regexp_replace(schema, rf"({name})(?=: )", "=$1"), F.lit(rf"={name}|OBJECT<|ARRAY<|>|[A-Z_]+"), F.lit(0))
    text = F.lit("").cast("string")
    zero = F.struct(F.array(text).alias("stack"), text.alias("at"), F.array().cast("array<string>").alias("found"))

    def state(s: Column, stack=None, at=None, found=None) -> Column:
        return F.struct((s["stack"] if stack is None else stack).alias("stack"), (s["at"] if at is None else at).alias("at"), (s["found"] if found is None else found).alias("found"))

    def step(s: Column, w: Column) -> Column:
        top = F.element_at(s["stack"], -1)
        name = w.substr(F.lit(2), F.length(w))
        name = F.when(name.startswith("`"), F.regexp_replace(name.substr(F.lit(2), F.length(name) - 2), "``", "`")).otherwise(name)
        inner = F.concat(s["at"], F.lit("[]"))
        is_type = w.isin("VOID", "STRING", "BIGINT", "DOUBLE", "FLOAT", "BOOLEAN", "BINARY", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "VARIANT", "UUID", "DECIMAL")
        return (
            F.when(w == "OBJECT<", state(s, stack=F.concat(s["stack"], F.array(s["at"]))))
            .when(w == "ARRAY<", state(s, stack=F.concat(s["stack"], F.array(inner)), at=inner))
            .when(w == ">", state(s, stack=F.slice(s["stack"], 1, F.size(s["stack"]) - 1)))
            .when(w.startswith("="), state(s, at=F.concat(top, F.when(top == "", F.lit("")).otherwise(F.lit(".")), name)))
            .when(is_type, state(s, found=F.concat(s["found"], F.array(s["at"]))))
            .otherwise(s)
        )

    return F.when(schema.startswith("OBJECT<"), F.aggregate(words, zero, step)["found"])


def fingerprint(found: Column) -> Column:
    """Hash of the paths that some mapping names; other fields of a record don't matter."""
    known = F.array(*map(F.lit, VOCABULARY))
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(found, known)), "\n"), 256)


def _canonical(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    low = F.lower(F.coalesce(role, F.lit("")))
    return F.coalesce(F.try_element_at(names, low), low)


def _turns(mapping: Mapping, record: Column) -> Column:
    get = lambda p: F.try_variant_get(record, f"$.{p}", "string")
    fixed = []
    for role, where in mapping.turns:
        text = F.concat_ws("\n\n", *(F.when(get(p) != "", get(p)) for p in where.split("\n\n")))
        must = any(p in mapping.required for p in where.split("\n\n"))
        fixed.append(F.when(F.lit(must) | (text != ""), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    out = F.filter(F.array(*fixed), lambda t: t.isNotNull()) if fixed else F.array().cast(_TURNS)
    if mapping.each:
        array, role, text = mapping.each
        rows = F.try_variant_get(record, f"$.{array}", f"array<struct<`{role}`: string, `{text}`: string>>")
        each = F.transform(F.coalesce(rows, F.array()), lambda t: F.struct((F.coalesce(t[role], F.lit("")) if mapping.exact else _canonical(t[role])).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
        out = F.concat(out.cast(_TURNS), each.cast(_TURNS))
    return out.cast(_TURNS)


def turns_of_json(records: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """keep, fingerprint, mapping, turns for a column of JSON records of mixed layouts.

    Null, malformed and non-object records, and layouts that no mapping names, have mapping null and no turns. Fields
    that no mapping names are ignored. Kept columns that are named as a result, or `_record`, give way to it.
    """
    keep = [c for c in keep if c not in ("_record", "fingerprint", "mapping", "turns")]
    record = F.try_parse_json(F.col(json_col))
    out = records.select(*keep, record.alias("_record")).withColumn("fingerprint", fingerprint(paths(F.col("_record"))))
    names = F.create_map(*(F.lit(x) for pair in BY_FINGERPRINT.items() for x in pair))
    out = out.withColumn("mapping", F.when(F.col("fingerprint").isNotNull(), F.try_element_at(names, F.col("fingerprint"))))
    turns = F.array().cast(_TURNS)
    for m in MAPPINGS:
        if m.turns or m.each:
            turns = F.when(F.col("mapping") == m.name, _turns(m, F.col("_record"))).otherwise(turns)
    return out.withColumn("turns", turns).drop("_record")


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turns for a table with a row per turn; its schema's fingerprint must select the mapping of such tables.

    Turns go by turn number, ties by role and text; repeated rows are turns of their own. Null role or text: empty. A
    null conv_id is a conversation of its own. Other columns are ignored. No rows: no conversations.
    """
    found = fingerprint_of(tuple(p for p in schema_paths(rows.schema) if p in VOCABULARY))
    if BY_FINGERPRINT.get(found) != "turn_rows":
        raise ValueError(f"no row mapping for the fields {rows.columns}")
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.cast(_TURNS).alias("turns"))


def records_of(turns: DataFrame) -> DataFrame:
    """Adds record, each conversation as a JSON record in one of the layouts that fit it.

    A question and an answer, with or without a system text before, become a prompt and a response or an instruction and
    an output; other conversations of known roles lists of messages, with either pair of field names; texts that are
    empty, and other roles, a list of turns as they are. Which of two layouts is by a hash of the texts.
    """
    role = lambda k: F.get("turns", k)["role"]
    text = lambda k: F.get("turns", F.lit(k) + F.col("_skip"))["text"]
    out = turns.withColumn("_skip", (role(0) == "system").cast("int")).withColumn("_skip", F.coalesce("_skip", F.lit(0)))
    plain = F.forall("turns", lambda t: t["role"].isin("system", "user", "assistant") & (t["text"] != ""))
    pair = (F.size("turns") == 2 + F.col("_skip")) & (F.get("turns", F.col("_skip"))["role"] == "user") & (F.get("turns", 1 + F.col("_skip"))["role"] == "assistant")
    system = F.when(F.col("_skip") == 1, F.get("turns", F.lit(0))["text"]).alias("system")
    first = F.pmod(F.xxhash64(F.transform("turns", lambda t: F.length(t["text"]))), F.lit(2)) == 0
    told = F.transform("turns", lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["text"].alias("value")))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    layouts = [
        (plain & pair & first, F.struct(text(0).alias("prompt"), text(1).alias("response"), system)),
        (plain & pair, F.struct(text(0).alias("instruction"), text(1).alias("output"), system)),
        (plain & first, F.struct(messages.alias("messages"))),
        (plain, F.struct(told.alias("conversations"))),
    ]
    record = F.to_json(F.struct("turns"))
    for fits, layout in reversed(layouts):
        record = F.when(fits, F.to_json(layout)).otherwise(record)
    return out.withColumn("record", record).drop("_skip")


def turns_by_layout(rows: DataFrame) -> DataFrame:
    """conv_id, mapping, turns of a table with a row per turn, by way of records in mixed layouts.

    Rows are gathered as in `turns_of_rows` and written as records by `records_of`; each record's own fingerprint then
    selects the mapping that reads it. A record beyond what a JSON value can hold keeps its rows' turns, mapping turn_rows.
    """
    kept = records_of(turns_of_rows(rows)).withColumnRenamed("turns", "_rows")
    out = turns_of_json(kept, "record", ["conv_id", "_rows"])
    return out.select("conv_id", F.coalesce("mapping", F.lit("turn_rows")).alias("mapping"), F.when(F.col("mapping").isNull(), F.col("_rows")).otherwise(F.col("turns")).alias("turns"))


#: The strings that mark turns.
BEGIN, USER, USER_END, END, ROLE, ROLE_END = "<s>", "[INST] ", " [/INST]", "</s>", "<<ROLE>>", "<</ROLE>>"
_CONTROL = r"([<\[])(/?s>|/?INST\]|</?SYS>>|</?ROLE>>)"


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _marked(t: Column) -> Column:
    text = escape(t["text"])
    other = F.concat(F.lit(ROLE), escape(t["role"]), F.lit(ROLE_END), text, F.lit(END))
    return F.when(t["role"] == "user", F.concat(F.lit(USER), text, F.lit(USER_END))).when(t["role"] == "assistant", F.concat(text, F.lit(END))).otherwise(other)


def formatted(turns: DataFrame) -> DataFrame:
    """Adds text, the marked conversation, and loss, the (start, length) in code points of each assistant text in it."""
    parts = F.transform("turns", _marked)
    lengths = F.transform(F.arrays_zip("turns", parts.alias("part")), lambda z: F.struct((z["turns"]["role"] == "assistant").alias("own"), F.length(z["part"]).alias("n")))
    zero = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        span = F.struct(s["at"].alias("start"), (x["n"] - len(END)).alias("length"))
        return F.struct((s["at"] + x["n"]).alias("at"), F.when(x["own"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    out = turns.withColumn("text", F.concat(F.lit(BEGIN), F.array_join(parts, "")))
    return out.withColumn("loss", F.aggregate(lengths, zero, step)["spans"])


def read_back(text: Column) -> Column:
    """The turns that a marked conversation holds."""
    body = text.substr(F.lit(len(BEGIN) + 1), F.length(text))
    chunks = F.filter(F.split(body, r"(?<= \[/INST\]|</s>)"), lambda c: c != "")

    def turn(c: Column) -> Column:
        user = c.substr(F.lit(len(USER) + 1), F.length(c) - len(USER) - len(USER_END))
        rest = c.substr(F.lit(1), F.length(c) - len(END))
        role = F.substring_index(rest, ROLE_END, 1)
        after = rest.substr(F.length(role) + len(ROLE_END) + 1, F.length(rest))
        pair = lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text"))
        other = pair(role.substr(F.lit(len(ROLE) + 1), F.length(role)), after)
        return F.when(c.startswith(USER), pair(F.lit("user"), user)).when(c.startswith(ROLE), other).otherwise(pair(F.lit("assistant"), rest))

    return F.transform(chunks, turn)


def masked(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; the outer transform binds the text once per row."""
    cut = lambda t: F.array_join(F.transform(loss, lambda x: unescape(t.substr(x["start"] + 1, x["length"]))), "")
    return F.element_at(F.transform(F.array(text), cut), 1)
