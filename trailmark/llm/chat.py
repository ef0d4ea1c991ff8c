"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a template marks turns and loss.

A record is JSON. Its fingerprint is a hash of its nested field paths (its schema, without values and OPTIONAL fields). MAPPINGS names, for each known
layout, where its turns are: a list of messages with the fields for role and text, or fields that become single turns. All of
this, the template, its escapes and the reading back are DataFrame expressions.

The template writes `<|turn|>role\\ntext<|end|>\\n`. Within roles and texts a backslash is doubled, and one is put behind the
first character of every control string, so that no control string is left and unescaping is exact. The loss mask is a list of
spans, in code points, over the assistants' texts.

Cases: a null role or text counts as empty; a null conversation id is one conversation; turns are ordered by turn, then role and text, nulls
first; repeated rows are repeated turns; a conversation without assistant has an empty mask; records of unknown layout or broken
JSON have a null layout and null turns, and are returned so; Spark reads no JSON string of over 20 million characters and no record
beyond a variant's size: what it doesn't read of such length has too_large set, so that it isn't taken for broken; turns that are columns
already never become JSON and have no such limit; empty tables give empty tables; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Strings that templates of common models give a meaning to (fixed values).
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LEARNED_ROLE = "assistant"
#: Spark's JSON reader takes strings of at most so many characters (fixed value).
MOST_JSON_STRING = 20_000_000
#: Single values that records of any layout may have besides; they have no part in a fingerprint (fixed values).
OPTIONAL = ["id", "index", "lang", "name", "source", "weight"]
#: Conversations of more bytes of roles and texts than these stay columns.
MOST_RECORD = 4 << 20
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are: (role, path) of single fields in order, then messages at `path` with their fields' names."""

    layout: str
    singles: tuple[tuple[str, str], ...] = ()
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        """All field paths, [] after lists."""
        found = [p for _, p in self.singles]
        if self.messages:
            found += [f"{self.messages}[].{x}" for x in (self.role, self.text)]
        return sorted(found)


#: Layouts of prompt, instruction and message records (fixed values).
MAPPINGS = [
    Mapping("messages", messages="messages"),
    Mapping("turns", messages="turns", text="text"),
    Mapping("conversations", messages="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("system_messages", (("system", "system"),), messages="messages"),
    Mapping("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction_output", (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input_output", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("nested_chat", (("user", "chat.user.text"), ("assistant", "chat.assistant.text"))),
]


def paths_of(payload: str) -> Column:
    """The nested field paths of a JSON string column, names sorted at each level, without the types of values and without OPTIONAL
    fields; null where it isn't JSON."""
    shape = F.expr(f"schema_of_variant(try_parse_json({payload}))")
    plain = F.regexp_replace(shape, r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9,]+\))?", ": VALUE")
    extra = f"(?:{'|'.join(OPTIONAL)}): VALUE"
    return F.regexp_replace(F.regexp_replace(plain, rf"(?<=OBJECT<)(?:{extra}(?:, |(?=>)))+", ""), f", {extra}(?=[,>])", "")


def layouts() -> dict[str, Mapping]:
    """Each mapping by the field paths of its records."""
    out = {}
    for m in MAPPINGS:
        tree: dict = {}
        for path in m.paths():
            at = tree
            *way, leaf = path.replace("[]", ".[]").split(".")
            for step in way:
                at = at.setdefault(step, {})
            at[leaf] = "VALUE"

        def shown(node) -> str:
            if isinstance(node, str):
                return node
            if "[]" in node:
                return f"ARRAY<{shown(node['[]'])}>"
            return "OBJECT<" + ", ".join(f"{k}: {shown(node[k])}" for k in sorted(node)) + ">"

        out[shown(tree)] = m
        if m.messages and not m.singles:
            out[f"OBJECT<{m.messages}: ARRAY<VOID>>"] = m  # no messages yet
    return out


def canonical(records: DataFrame, key: str, payload: str) -> DataFrame:
    """key, fingerprint, layout, turns (array of role and text) and too_large (not read, and long enough to be beyond Spark's limits)
    for each JSON record."""
    rows = records.select(F.col(key).alias("_key"), F.col(payload).cast("string").alias("_payload"))
    shaped = rows.withColumn("_shape", paths_of("_payload")).withColumn("fingerprint", F.when(F.col("_shape").isNotNull(), F.xxhash64("_shape")))
    turns, layout = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for shape, m in layouts().items():
        known = F.col("fingerprint") == F.xxhash64(F.lit(shape))
        fields = [F.struct(F.lit(role).alias("role"), F.get_json_object("_payload", f"$.{path}").alias("text")) for role, path in m.singles]
        found = F.array(*fields) if fields else F.array().cast("array<struct<role:string,text:string>>")
        if m.messages:
            listed = F.from_json(F.get_json_object("_payload", f"$.{m.messages}"), f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
            renamed = lambda r, m=m: _role(r, m)
            found = F.concat(found, F.transform(listed, lambda x: F.struct(renamed(x[m.role]).alias("role"), x[m.text].alias("text"))))  # noqa: B023
        turns, layout = F.when(known, found).otherwise(turns), F.when(known, m.layout).otherwise(layout)
    too_large = F.coalesce(F.col("_shape").isNull() & (F.length("_payload") > MOST_JSON_STRING), F.lit(False))
    return shaped.select(F.col("_key").alias(key), "fingerprint", layout.alias("layout"), turns.alias("turns"), too_large.alias("too_large"))


def _role(role: Column, m: Mapping) -> Column:
    out = role
    for a, b in m.roles:
        out = F.when(role == a, b).otherwise(out)
    return out


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and turns (array of role and text, in order) of each conversation's rows."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # one conversation is one record of output
    return listed.select(F.col("_key").alias(key), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def conversations_as_records(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns and payload: each conversation as one JSON record, its layout chosen by a hash of the key among those that can say it. Payload
    is null for conversations of more than MOST_RECORD bytes, which never become JSON."""
    role, text = (lambda i, f=f: F.get("turns", F.lit(i))[f] for f in ("role", "text"))
    content = lambda r, t: F.transform("turns", lambda x: F.struct(x["role"].alias(r), x["text"].alias(t)))
    human = F.transform("turns", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    pair = lambda a, b: F.to_json(F.struct(text(0).alias(a), text(1).alias(b)))
    nested = F.struct(F.struct(*(F.struct(text(i).alias("text")).alias(r) for i, r in enumerate(("user", "assistant")))).alias("chat"))
    listed = [F.to_json(F.struct(content("role", "content").alias("messages"))), F.to_json(F.struct(content("role", "text").alias("turns")))]
    paired = [pair("prompt", "completion"), pair("prompt", "response"), pair("question", "answer"), pair("instruction", "output"), F.to_json(nested)]
    renamed = F.exists("turns", lambda x: x["role"].isin("human", "gpt"))  # a layout that renames roles can't say these
    is_pair = (F.size("turns") == 2) & (role(0) == "user") & (role(1) == "assistant")
    number = lambda n: F.pmod(F.xxhash64("_key"), F.lit(n))
    one_of = lambda options, n: F.coalesce(*(F.when(n == i, x) for i, x in enumerate(options)))
    every = [*listed, F.to_json(F.struct(human.alias("conversations")))]
    record = F.when(is_pair, one_of(paired, number(len(paired)))).when(renamed, one_of(listed, number(len(listed)))).otherwise(one_of(every, number(len(every))))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["role"]) + F.octet_length(x["text"]))
    return conversations(turns, key).withColumnRenamed(key, "_key").select(F.col("_key").alias(key), "turns", F.when(size <= MOST_RECORD, record).alias("payload"))


def canonicalised(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and turns of each conversation, through a record of some layout and the mapping that its fingerprint selects. A record that no
    mapping reads is an error, never a conversation without turns."""
    records = conversations_as_records(turns, key).select(F.struct(F.col(key).alias("key"), F.when(F.col("payload").isNull(), F.col("turns")).alias("turns")).alias("_both"), F.coalesce("payload", F.lit("{}")).alias("payload"))
    found = canonical(records, "_both", "payload")
    return found.select(F.col("_both.key").alias(key), F.coalesce("_both.turns", "turns", F.raise_error(F.lit("a record of no known layout")).cast(TURNS)).alias("turns"))


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted and loss_spans (start and length, in code points) for records with canonical turns."""

    def of_parts(parts: Column) -> Column:
        step = lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("at"),
            F.when(p["role"] == LEARNED_ROLE, F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        )
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
        text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
        return F.struct(text.alias("formatted"), F.aggregate(parts, begin, step, lambda s: s["spans"]).alias("loss_spans"))

    clean = lambda x: F.coalesce(x, F.lit(""))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escaped_role(clean(t["role"])), F.lit("\n")).alias("head"), escaped(clean(t["text"])).alias("body"), clean(t["role"]).alias("role")))
    done = records.select(F.col(key).alias("_key"), F.explode(F.array(F.transform(F.array(parts), of_parts)[0])).alias("_done"))
    return done.select(F.col("_key").alias(key), "_done.formatted", "_done.loss_spans")


def read_back(texts: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns (array of role and text) and loss_text, from formatted text and its loss spans alone."""
    segments = F.split("formatted", r"<\|end\|>\n", -1)
    header = r"(?s)\A<\|turn\|>((?:[^\\\n]|\\.)*+)\n(.*)\z"
    turns = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda s: F.struct(unescaped(F.regexp_extract(s, header, 1)).alias("role"), unescaped(F.regexp_extract(s, header, 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda p: unescaped(F.col("formatted").substr(p["start"] + 1, p["length"]))), "")
    return texts.select(key, "formatted", turns.alias("turns"), loss.alias("loss_text"))


def digested(texts: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the output."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(texts, key).select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def _sql_escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


ORACLE_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
lined AS (SELECT *, length({_sql_escaped("text")}) + length(replace({_sql_escaped("role")}, chr(10), '\\' || chr(10))) + {len(OPEN) + 1 + len(CLOSE)} AS chars FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM lined GROUP BY conv_id
"""
