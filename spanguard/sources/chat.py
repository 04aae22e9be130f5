"""Chat requests and responses of several providers, as column expressions over JSON bodies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host fragments in the order in which they are tried.
HOSTS = (("anthropic.com", "anthropic"), ("openai.com", "openai"), ("googleapis.com", "google"))
# Fixed value: hosts whose traffic is read by default.
DOMAINS = ("api.anthropic.com", "api.openai.com", "generativelanguage.googleapis.com", "api.mistral.ai", "api.groq.com")

MESSAGES = "array<struct<role:string,content:string>>"


def provider(host: Column) -> Column:
    out = F.when(host.contains(HOSTS[0][0]), HOSTS[0][1])
    for part, name in HOSTS[1:]:
        out = out.when(host.contains(part), name)
    return out.otherwise("unknown")


def intercepted(host: Column, domains: tuple[str, ...] = DOMAINS) -> Column:
    return host.isin(*domains)


def _parsed(body: Column, of: Callable[[Column], Column]) -> Column:
    """of(the body as a variant): the body is parsed once, however often its fields are asked for; null if it isn't JSON."""
    return F.transform(F.array(F.try_parse_json(body)), of)[0]


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column, path: str) -> Column:
    """A string of a variant at the path; null for values of other kinds."""
    return F.when(F.schema_of_variant(_at(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def _items(value: Column, path: str) -> Column:
    """Elements of a variant's array at the path; null if it isn't an array."""
    return F.try_variant_get(value, path, "array<variant>")


def text_parts(content: Column) -> Column:
    """The text of parts of type text, joined."""
    part = lambda p: F.when(_text(p, "$.type") == "text", _text(p, "$.text"))
    return F.array_join(F.transform(content, part), "")


def block_parts(content: Column) -> Column:
    """Text, thinking, tool calls and tool results of content blocks, joined."""

    def result(b: Column) -> Column:
        text = F.coalesce(_text(b, "$.content"), text_parts(_items(b, "$.content")))
        return F.when(F.length(text) > 0, F.concat(F.lit("[result] "), text))

    def block(b: Column) -> Column:
        kind = _text(b, "$.type")
        return (
            F.when(kind == "text", _text(b, "$.text"))
            .when((kind == "thinking") & (F.length(_text(b, "$.thinking")) > 0), F.concat(F.lit("[thinking] "), _text(b, "$.thinking")))
            .when(kind == "tool_use", F.concat(F.lit("["), F.coalesce(_text(b, "$.name"), F.lit("unknown")), F.lit("] "), F.coalesce(F.to_json(_at(b, "$.input")), F.lit(""))))
            .when(kind == "tool_result", result(b))
        )

    return F.array_join(F.transform(content, block), "")


def _messages(body: Column, path: str, content) -> Column:
    one = lambda m: F.struct(F.coalesce(_text(m, "$.role"), F.lit("user")).alias("role"), F.coalesce(content(m), F.lit("")).alias("content"))
    return F.transform(_items(body, path), one)


def _string_or(m: Column, parts) -> Column:
    return F.coalesce(_text(m, "$.content"), parts(_items(m, "$.content")))


def _openai(v: Column) -> Column:
    messages = _messages(v, "$.messages", lambda m: _string_or(m, text_parts))
    return F.when(_text(v, "$.model").isNotNull() & messages.isNotNull(), F.struct(_text(v, "$.model").alias("model"), messages.cast(MESSAGES).alias("messages")))


def _anthropic(v: Column) -> Column:
    none = F.array().cast(MESSAGES)
    system = F.when(_text(v, "$.system").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), _text(v, "$.system").alias("content"))).cast(MESSAGES)).otherwise(none)
    messages = F.coalesce(_messages(v, "$.messages", lambda m: _string_or(m, block_parts)).cast(MESSAGES), none)
    return F.when(_text(v, "$.model").isNotNull(), F.struct(_text(v, "$.model").alias("model"), F.concat(system, messages).alias("messages")))


def _google(v: Column) -> Column:
    content = lambda m: F.array_join(F.transform(_items(m, "$.parts"), lambda p: _text(p, "$.text")), "")
    messages = _messages(v, "$.contents", content)
    return F.when(messages.isNotNull(), F.struct(F.coalesce(_text(v, "$.model"), F.lit("gemini")).alias("model"), messages.cast(MESSAGES).alias("messages")))


def parse_openai(body: Column) -> Column:
    """struct(model, messages); null without a model and messages."""
    return _parsed(body, _openai)


def parse_anthropic(body: Column) -> Column:
    """struct(model, messages), a system prompt as the first message; null without a model."""
    return _parsed(body, _anthropic)


def parse_google(body: Column) -> Column:
    """struct(model, messages) from contents and parts; the model is `gemini` where the body names none."""
    return _parsed(body, _google)


def parse(name: Column, body: Column) -> Column:
    """By provider; unknown ones are read in the most common shape."""
    return _parsed(body, lambda v: F.when(name == "anthropic", _anthropic(v)).when(name == "google", _google(v)).otherwise(_openai(v)))


def entries(body: Column, field: str = "messages") -> Column:
    """array of (msg_idx, part_idx, text): string contents, and text parts of array contents."""

    def of(m: Column, i: Column) -> Column:
        parts = _items(m, "$.content")
        text = _text(m, "$.content")
        many = F.filter(F.transform(parts, lambda p, j: F.struct(i.alias("msg_idx"), j.alias("part_idx"), F.when(_text(p, "$.type") == "text", _text(p, "$.text")).alias("text"))), lambda e: e["text"].isNotNull())
        one = F.array(F.struct(i.alias("msg_idx"), F.lit(None).cast("int").alias("part_idx"), text.alias("text")))
        return F.when(text.isNotNull(), one).otherwise(F.coalesce(many, F.array().cast("array<struct<msg_idx:int,part_idx:int,text:string>>")))

    return _parsed(body, lambda v: F.flatten(F.transform(_items(v, f"$.{field}"), of)))


def with_content_length(headers: Column, body: Column) -> Column:
    """Header lines with the length of the body, in bytes; names in any case keep theirs, line ends stay."""
    return F.regexp_replace(headers, r"(?im)^(content-length):[^\r\n]*", F.concat(F.lit("$1: "), F.octet_length(body).cast("string")))


# ---------------------------------------------------------------- responses
def delta(name: Column, event_type: Column, data: Column) -> Column:
    """The text that one server-sent event adds; null if none."""
    kind = F.get_json_object(data, "$.delta.type")
    thinking = F.get_json_object(data, "$.delta.thinking")
    anthropic = (
        F.when((event_type == "content_block_start") & (F.get_json_object(data, "$.content_block.type") == "tool_use"), F.concat(F.lit("\n["), F.coalesce(F.get_json_object(data, "$.content_block.name"), F.lit("unknown")), F.lit("] ")))
        .when((event_type == "content_block_delta") & (kind == "text_delta"), F.get_json_object(data, "$.delta.text"))
        .when((event_type == "content_block_delta") & (kind == "input_json_delta"), F.get_json_object(data, "$.delta.partial_json"))
        .when((event_type == "content_block_delta") & (kind == "thinking_delta") & (F.length(thinking) > 0), F.concat(F.lit("[thinking] "), thinking))
    )
    openai = F.when(F.trim(data) != "[DONE]", F.get_json_object(data, "$.choices[0].delta.content"))
    google = F.get_json_object(data, "$.candidates[0].content.parts[0].text")
    return F.when(name == "anthropic", anthropic).when(name == "google", google).otherwise(openai)


def done(event_type: Column, data: Column) -> Column:
    return (F.trim(data) == "[DONE]") | F.coalesce(event_type == "message_stop", F.lit(False))


def usage(name: Column, event_type: Column, data: Column) -> Column:
    """struct(tokens_in, tokens_out) that an event reports."""
    n = lambda path: F.get_json_object(data, path).cast("long")
    none = F.lit(None).cast("long")
    made = lambda i, o: F.struct(i.alias("tokens_in"), o.alias("tokens_out"))
    return (
        F.when((name == "anthropic") & (event_type == "message_start"), made(n("$.message.usage.input_tokens"), n("$.message.usage.output_tokens")))
        .when((name == "anthropic") & (event_type == "message_delta"), made(none, n("$.usage.output_tokens")))
        .when(name == "google", made(n("$.usageMetadata.promptTokenCount"), n("$.usageMetadata.candidatesTokenCount")))
        .otherwise(made(none, none))
    )


def response_usage(name: Column, body: Column) -> Column:
    """struct(tokens_in, tokens_out) of a complete response."""
    n = lambda *paths: F.coalesce(*[F.get_json_object(body, p) for p in paths]).cast("long")
    google = F.struct(n("$.usageMetadata.promptTokenCount").alias("tokens_in"), n("$.usageMetadata.candidatesTokenCount").alias("tokens_out"))
    other = F.struct(n("$.usage.input_tokens", "$.usage.prompt_tokens").alias("tokens_in"), n("$.usage.output_tokens", "$.usage.completion_tokens").alias("tokens_out"))
    return F.when(name == "google", google).otherwise(other)


def response_text(body: Column) -> Column:
    """Text blocks of a complete response, joined; null if it has no content array."""
    return _parsed(body, lambda v: F.when(_items(v, "$.content").isNotNull(), text_parts(_items(v, "$.content"))))


def rewrite_delta(name: Column, data: Column, text: Column) -> Column:
    """The event's JSON with its text replaced; events without a text stay."""
    old = F.to_json(F.struct(F.when(name == "anthropic", F.get_json_object(data, "$.delta.text")).when(name == "google", F.get_json_object(data, "$.candidates[0].content.parts[0].text")).otherwise(F.get_json_object(data, "$.choices[0].delta.content")).alias("text")))
    new = F.to_json(F.struct(text.alias("text")))
    key = F.when(name == "openai", F.lit('"content":')).otherwise(F.lit('"text":'))
    value = lambda j: F.regexp_extract(j, r'^\{"text":(.*)\}$', 1)
    return F.when(old == "{}", data).otherwise(F.replace(F.regexp_replace(data, r'"(text|content)"\s*:\s*', '"$1":'), F.concat(key, value(old)), F.concat(key, value(new))))


def remind(name: Column, parsed: Column, system_kind: Column, reminder: str) -> Column:
    """messages of a parsed request with the reminder: in the system prompt, or as a new first message.

    system_kind: `string`, `none` or `other` for the body's system field; a system field of another kind, and
    other providers' requests, stay as they are.
    """
    block = f"<system-reminder>\n{reminder}\n</system-reminder>"
    messages = parsed["messages"]
    has = F.exists(messages, lambda m: m["role"] == "system")
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "system") - 1
    added = F.transform(messages, lambda m, i: F.when(i == first, F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("\n\n" + block)).alias("content"))).otherwise(m))
    new = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(block).alias("content"))), messages)
    can = (name == "openai") | ((name == "anthropic") & (system_kind != "other"))
    return F.when(~can, messages).when(has, added).otherwise(new)


def system_kind(body: Column) -> Column:
    kind = F.schema_of_variant(_at(F.try_parse_json(body), "$.system"))
    return F.when(kind.isNull() | (kind == "VOID"), "none").when(kind == "STRING", "string").otherwise("other")
