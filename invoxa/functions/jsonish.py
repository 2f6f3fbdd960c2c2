"""Model-response text handling: JSON carve-out and strict schema checks.

Validation follows the response schemas field by field on Spark's VARIANT
type: ``try_parse_json`` then ``schema_of_variant`` type tests, so a number
where a string is required fails (a plain ``from_json`` would silently turn
it into text) and an explicit JSON ``null`` is told apart from an absent key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from invoxa.functions.patterns import strip_ws

# FIXED VALUES: schema field names.
HEADER_FIELDS = ("supplierName", "invoiceNumber", "invoiceDate", "kvkNumber", "vatNumber")
CASE_FIELDS = ("validatedClientCaseNumber", "rawClientCaseNumber", "date")
# FIXED VALUES: strings accepted for a boolean field (case-insensitive).
BOOL_TRUE = ("1", "on", "t", "true", "y", "yes")
BOOL_FALSE = ("0", "off", "f", "false", "n", "no")
NUMBER_TEXT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"

HEADER_TYPE = ("struct<invoiceHeader:struct<supplierName:string,invoiceNumber:string,"
               "invoiceDate:string,kvkNumber:string,vatNumber:string>,isCoachingInvoice:boolean>")
CASE_TYPE = ("struct<validatedClientCaseNumber:string,rawClientCaseNumber:string,date:string,"
             "durationHours:double>")
# What a header answer is read as: its parts one by one, each with its own type.
_HEADER_PARTS = ("struct<invoiceHeader:struct<" + ",".join(f"{f}:variant" for f in HEADER_FIELDS)
                 + ">,isCoachingInvoice:variant>")
_ITEM_PARTS = "struct<" + ",".join(f"{f}:variant" for f in (*CASE_FIELDS, "durationHours")) + ">"
LINES_TYPE = f"struct<clientCases:array<{CASE_TYPE}>,clientCasesNoActivity:array<string>>"

# The type, as ``schema_of_variant`` prints it, of a list of answers that one typed read gives
# as their result: nothing but known keys, each of its plain type. Types of list entries are
# merged there, so a NULL or an absent key can hide in any of them.
_TEXT, _NUMBER = "(STRING|VOID)", r"(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\)|VOID)"


def _keys(**types: str) -> str:
    """The keys of an object in order, any of them missing."""
    return "".join(f"((, )?{name}: {t})?" for name, t in sorted(types.items()))


PLAIN_HEADER = (f"^ARRAY<OBJECT<invoiceHeader: OBJECT<{_keys(**{f: _TEXT for f in HEADER_FIELDS})}>, "
                "isCoachingInvoice: BOOLEAN>>$")
PLAIN_LINES = ("^ARRAY<OBJECT<(clientCases: ARRAY<(VOID|OBJECT<"
               + _keys(**{f: _TEXT for f in CASE_FIELDS}, durationHours=_NUMBER)
               + ">)>)?(, )?(clientCasesNoActivity: ARRAY<(STRING|VOID)>)?>>$")


def _once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once, not in each of its uses."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), 0)


def _last_pos(s: Column, ch: str) -> Column:
    # What follows the last one is the whole text when there is none.
    return F.length(s) - F.length(F.substring_index(s, ch, -1))


def carve_json(s: Column) -> Column:
    """The JSON object inside a model answer.

    Trimmed text from the first '{' to the last '}' (empty when the last '}'
    comes first); without braces, a leading ``` fence line is dropped and
    the text is cut at the next fence. NULL/empty input is returned as is.
    """
    # Between braces surrounding whitespace does not matter, so it is trimmed only without them.
    start, end = F.locate("{", s), _last_pos(s, "}")
    braces = F.when(end >= start, F.substring(s, start, end - start + 1)).otherwise(F.lit(""))

    def bare(t: Column) -> Column:
        unfenced = _once(strip_ws(F.regexp_replace(t, r"^[^\n]*(\n|$)", "")), lambda rest: F.when(
            F.locate("```", rest) > 0, strip_ws(F.substring_index(rest, "```", 1))).otherwise(rest))
        return F.when(t.startswith("```"), unfenced).otherwise(t)

    return (F.when(s.isNull() | (s == ""), s).when(s.contains("{") & s.contains("}"), braces)
            .otherwise(_once(strip_ws(s), bare)))


def vget(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant")


def vtype(v: Column) -> Column:
    """Variant type name; NULL when the value is absent."""
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def _is(v: Column, name: str) -> Column:
    return F.coalesce(vtype(v) == name, F.lit(False))


def _starts(v: Column, prefix: str) -> Column:
    return F.coalesce(vtype(v).startswith(prefix), F.lit(False))


def is_object(v: Column) -> Column:
    # Structs without fields copy nothing; the type name of a container would spell
    # out its whole nested schema, and variants inside it would be built anew.
    return F.coalesce(F.try_variant_get(v, "$", "struct<>").isNotNull(), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<struct<>>").isNotNull(), F.lit(False))


def _number_type(t: Column) -> Column:
    return F.coalesce(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
                      | t.startswith("DECIMAL"), F.lit(False))


def is_number(v: Column) -> Column:
    return _number_type(vtype(v))


def absent_or_null(v: Column) -> Column:
    return v.isNull() | _is(v, "VOID")


def opt_string_ok(v: Column) -> Column:
    return absent_or_null(v) | _is(v, "STRING")


def opt_string(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def bool_value(v: Column) -> Column:
    """Lax boolean: JSON bool, number 0/1, or one of the accepted strings."""
    s = F.lower(F.try_variant_get(v, "$", "string"))
    num = F.try_variant_get(v, "$", "double")
    return (F.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean"))
            .when(is_number(v) & (num == 1.0), F.lit(True))
            .when(is_number(v) & (num == 0.0), F.lit(False))
            .when(_is(v, "STRING") & s.isin(*BOOL_TRUE), F.lit(True))
            .when(_is(v, "STRING") & s.isin(*BOOL_FALSE), F.lit(False)))


def float_value(v: Column, t: Column | None = None) -> Column:
    """Lax float: JSON number, numeric string or bool; NULL otherwise. A string must
    look like a number: the cast alone would accept type suffixes (``1.5d``). ``t``:
    ``vtype(v)``, if it is at hand."""
    t = vtype(v) if t is None else t
    s = strip_ws(F.try_variant_get(v, "$", "string"))
    return (F.when(_number_type(t), F.try_variant_get(v, "$", "double"))
            .when((t == "STRING") & s.rlike(NUMBER_TEXT), s.try_cast("double"))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")))


def opt_float_ok(v: Column) -> Column:
    return absent_or_null(v) | float_value(v).isNotNull()


# Strict JSON, as far as the reader can be told.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_LOOSE_HEADER = ("invoiceHeader struct<" + ", ".join(f"{f}: variant" for f in HEADER_FIELDS)
                 + ">, isCoachingInvoice variant")
_LOOSE_LINES = ("clientCases array<struct<" + ", ".join(f"{f}: variant" for f in (*CASE_FIELDS, "durationHours"))
                + ">>, clientCasesNoActivity array<variant>")


def _last_of_duplicates(carved: Column, schema: str) -> Column:
    """VARIANT of an answer whose objects repeat a key, each with its last value.

    The VARIANT parser refuses such an answer. Read by schema, a later value takes the
    place of an earlier one, and a value of another shape marks the record as corrupt:
    that fails the answer, even if only the earlier one was so.
    """
    fields = [f for f in ("invoiceHeader", "isCoachingInvoice", "clientCases", "clientCasesNoActivity") if f in schema]
    single = F.size(F.from_json(F.concat(F.lit("["), carved, F.lit("]")), "array<struct<invoiceHeader: string>>", _STRICT)) == 1

    def repaired(read: Column) -> Column:
        sound = carved.startswith("{") & single & read["_corrupt_record"].isNull()
        for name in fields:
            if name in ("clientCases", "clientCasesNoActivity"):  # an explicit null is no list
                sound = sound & ~(F.array_contains(F.json_object_keys(carved), name) & read[name].isNull())
        return F.when(sound, F.try_parse_json(F.to_json(F.struct(*(read[f].alias(f) for f in fields)))))

    return _once(F.from_json(carved, schema + ", _corrupt_record string", _STRICT), repaired)


def list_of_answer(carved: Column) -> Column:
    """VARIANT of the carved text in brackets: text after the JSON value makes the whole
    invalid or a longer list."""
    return F.try_parse_json(F.concat(F.lit("["), carved, F.lit("]")))


def plain_header(listed: Column) -> Column:
    """``header_from_variant`` of an answer of the plain form, by one typed read; NULL for any
    other, which says nothing about it. ``listed``: ``list_of_answer``, as a column."""
    one = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(one & F.schema_of_variant(listed).rlike(PLAIN_HEADER), F.try_variant_get(listed, "$[0]", HEADER_TYPE))


def plain_lines(listed: Column) -> Column:
    """``lines_from_variant`` of an answer of the plain form, by one typed read, but for the
    lists: a missing one is NULL, and NULL items, codes or names are not refused yet
    (``plain_lines_result``). NULL for any other form."""
    one = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(one & F.schema_of_variant(listed).rlike(PLAIN_LINES), F.try_variant_get(listed, "$[0]", LINES_TYPE))


def plain_lines_result(read: Column) -> Column:
    """The result that ``plain_lines`` stands for; NULL where a NULL or empty text in the lists
    asks for the whole check."""
    def filled(texts: Column) -> Column:
        # NULL, not false, where the text is not found and there are NULLs.
        return F.coalesce(~F.array_contains(texts, F.lit("")), texts.isNull())

    cases, names = read["clientCases"], read["clientCasesNoActivity"]
    result = F.struct(F.coalesce(cases, F.array().cast(f"array<{CASE_TYPE}>")).alias("clientCases"),
                      F.coalesce(names, F.array().cast("array<string>")).alias("clientCasesNoActivity"))
    return F.when(read.isNotNull() & filled(cases["validatedClientCaseNumber"]) & filled(names), result)


def parse_response(text: Column, lines: Column | bool = False, carved_text: Column | None = None) -> Column:
    """VARIANT of the carved response text (NULL when it is not JSON).

    Compute it once into a column (``withColumn``) and validate from that
    column: the checks below read many paths of the same document. Inside
    brackets, text after the JSON value makes the whole invalid or a longer list.
    A repeated key keeps its last value; ``lines`` says whether the answer is one
    with line items (only the fields of its kind are kept then). ``carved_text``:
    ``carve_json(text)``, if it is at hand as a column.
    """
    lines = F.lit(lines) if isinstance(lines, bool) else lines

    def parsed(carved: Column) -> Column:
        def only(listed: Column) -> Column:
            values = F.try_variant_get(listed, "$", "array<variant>")
            repaired = F.when(lines, _last_of_duplicates(carved, _LOOSE_LINES)).otherwise(
                _last_of_duplicates(carved, _LOOSE_HEADER))
            return F.when(listed.isNull(), repaired).otherwise(_once(values, lambda v: F.when(F.size(v) == 1, F.get(v, 0))))

        return _once(list_of_answer(carved), only)

    return _once(carve_json(text) if carved_text is None else carved_text, parsed)


def parse_header(text: Column) -> Column:
    return _once(parse_response(text), header_from_variant)


def header_from_variant(root: Column) -> Column:
    """HeaderResult from a parsed response, NULL when it does not validate.

    Required: object ``invoiceHeader`` (explicit null fails) and
    ``isCoachingInvoice``; the five header fields are optional strings;
    unknown keys are ignored.
    """
    parts = F.try_variant_get(root, "$", _HEADER_PARTS)  # NULL where there is no object

    def checked(h: Column, coach: Column) -> Column:
        valid = h.isNotNull() & coach.isNotNull()
        for f in HEADER_FIELDS:
            valid = valid & opt_string_ok(h[f])
        result = F.struct(F.struct(*[opt_string(h[f]).alias(f) for f in HEADER_FIELDS])
                          .alias("invoiceHeader"), coach.alias("isCoachingInvoice"))
        return F.when(valid, result)

    read = _once(parts, lambda p: F.when(p.isNotNull(), F.struct(
        p["invoiceHeader"].alias("header"), bool_value(p["isCoachingInvoice"]).alias("coach"))))
    return _once(read, lambda x: checked(x["header"], x["coach"]))


def item_facts(root: Column) -> Column:
    """Per line item, its type names and typed values, computed once.

    Store the result in a column (``withColumn``): the checks and the
    result struct then read plain struct fields instead of re-walking the
    VARIANT inside every lambda (no common-subexpression elimination runs
    inside higher-order functions).
    """
    # One read gives the fields of all items; an item that is no object is NULL.
    items = F.try_variant_get(root, "$.clientCases", f"array<{_ITEM_PARTS}>")

    def types(e: Column) -> Column:
        return F.struct(e.isNotNull().alias("is_obj"), e.alias("e"),
                        *[vtype(e[f]).alias(f"t_{f}") for f in CASE_FIELDS], vtype(e["durationHours"]).alias("t_hours"))

    def facts(x: Column) -> Column:
        cols = [x["is_obj"].alias("is_obj")]
        for f in CASE_FIELDS:
            t = x[f"t_{f}"]
            cols += [t.alias(f"t_{f}"), F.when(t == "STRING", F.try_variant_get(x["e"][f], "$", "string")).alias(f)]
        hours = float_value(x["e"]["durationHours"], x["t_hours"])
        return F.struct(*cols, x["t_hours"].alias("t_hours"), hours.alias("hours"))

    return F.transform(F.transform(items, types), facts)


def _fact_ok(x: Column) -> Column:
    def opt_str(f: str) -> Column:
        return x[f"t_{f}"].isNull() | x[f"t_{f}"].isin("VOID", "STRING")
    return (x["is_obj"] & F.coalesce(x["t_validatedClientCaseNumber"] == "STRING", F.lit(False))
            & opt_str("rawClientCaseNumber") & opt_str("date")
            & (x["t_hours"].isNull() | (x["t_hours"] == "VOID") | x["hours"].isNotNull()))


def _fact_case(x: Column) -> Column:
    return F.struct(x["validatedClientCaseNumber"].alias("validatedClientCaseNumber"),
                    x["rawClientCaseNumber"].alias("rawClientCaseNumber"),
                    x["date"].alias("date"), x["hours"].alias("durationHours"))


def parse_lines(text: Column) -> Column:
    return _once(parse_response(text, lines=True), lines_from_variant)


def lines_from_variant(root: Column, facts: Column | None = None) -> Column:
    """LineItemsResult from a parsed response, NULL when it does not validate.

    Both lists default to empty when the key is absent; an explicit null, a
    non-list, an item without ``validatedClientCaseNumber`` or a wrongly
    typed field fails the whole response. ``facts``: ``item_facts(root)``,
    ideally precomputed into a column.
    """
    facts = item_facts(root) if facts is None else facts
    names = F.try_variant_get(root, "$.clientCasesNoActivity", "array<variant>")

    def list_ok(listed: Column, name: str, each) -> Column:
        # What is no list is looked up again, to tell an absent key from a wrong value.
        return F.when(listed.isNotNull(), F.forall(listed, each)).otherwise(vget(root, f"$.{name}").isNull())

    valid = (is_object(root) & list_ok(facts, "clientCases", _fact_ok)
             & list_ok(names, "clientCasesNoActivity", lambda x: _is(x, "STRING")))
    cases = F.coalesce(F.transform(facts, _fact_case), F.array().cast(f"array<{CASE_TYPE}>"))
    no_act = F.coalesce(F.transform(names, opt_string), F.array().cast("array<string>"))
    return F.when(F.coalesce(valid, F.lit(False)),
                  F.struct(cases.alias("clientCases"), no_act.alias("clientCasesNoActivity")))
