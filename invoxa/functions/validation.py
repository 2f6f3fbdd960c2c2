"""What a failed validation of a model answer says: one (path, kind, type, text) per fault.

The retry rule searches the message of a failed validation for overload marks, and the message
quotes the values at fault the way Python prints them. So the faults are listed with their
paths and their printed values, from the VARIANT (types) and the answer's own text (order of
keys, numbers as written).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from invoxa.functions.jsonish import (HEADER_FIELDS, CASE_FIELDS, absent_or_null, bool_value, is_array, is_object,
                                      opt_string_ok, vget, vtype)

#: Longer printed values are shown by their first 25 and last 24 characters.
SHOWN_CHARS, SHOWN_HEAD, SHOWN_TAIL = 50, 25, 24

_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+'
_FAULT = "struct<path:string,kind:string,type:string,text:string>"


def string_repr(s: Column) -> Column:
    """A text as Python prints it: quotes chosen by the quotes inside, escapes for
    backslashes and line ends (other unprintable characters stay as they are)."""
    body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for ch, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(ch), F.lit(shown))
    double = s.contains("'") & ~s.contains('"')
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _number_repr(token: Column) -> Column:
    d = token.try_cast("double")
    whole = F.concat(d.try_cast("decimal(17,0)").cast("string"), F.lit(".0"))
    return (F.when(token.rlike(r"^-?\d+$"), token)
            .when((F.abs(d) >= 1e7) & (F.abs(d) < 1e16) & (d == F.floor(d)), whole)
            .otherwise(F.coalesce(d.cast("string"), token)))


def json_repr(raw: Column) -> Column:
    """JSON text as Python prints the value it stands for."""
    def shown(t: Column) -> Column:
        text = F.get_json_object(F.concat(F.lit('{"a":'), t, F.lit("}")), "$.a")
        return (F.when(t.startswith('"'), string_repr(text)).when(t == ":", ": ").when(t == ",", ", ")
                .when(t.isin("{", "}", "[", "]"), t).when(t == "true", "True").when(t == "false", "False")
                .when(t == "null", "None").otherwise(_number_repr(t)))
    return F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0)), shown), "")


def value_repr(kind: Column, text: Column) -> Column:
    """A value as Python prints it, from its VARIANT type and its text (strings without quotes)."""
    return F.when(kind == "STRING", string_repr(text)).when(kind == "VOID", "None").otherwise(json_repr(text))


def _fault(when: Column, path: Column | str, kind: str, v: Column | str, text: Column) -> Column:
    """A fault, or NULL; ``v`` is the value at fault or the name of its type, ``text`` its text."""
    path = F.lit(path) if isinstance(path, str) else path
    of = F.lit(v) if isinstance(v, str) else vtype(v)
    return F.when(F.coalesce(when, F.lit(False)),
                  F.struct(path.alias("path"), F.lit(kind).alias("kind"), of.alias("type"), text.alias("text")))


def _texts(raw: Column, fields: tuple[str, ...]) -> Column:
    return F.from_json(raw, "struct<" + ",".join(f"{f}:string" for f in fields) + ">")


def _all(root: Column, carved: Column, faults: list[Column]) -> Column:
    whole = [_fault(root.isNull(), "", "json_invalid", "STRING", carved),
             _fault(root.isNotNull() & ~is_object(root), "", "model_type", "OTHER", carved)]
    return F.array_compact(F.array(*whole, *(F.when(is_object(root), f) for f in faults)))


def header_faults(root: Column, carved: Column) -> Column:
    """Faults of a header answer; ``root`` its parsed and ``carved`` its carved text."""
    texts = _texts(carved, ("invoiceHeader", "isCoachingInvoice"))
    inner = _texts(texts["invoiceHeader"], HEADER_FIELDS)
    ih, coach = vget(root, "$.invoiceHeader"), vget(root, "$.isCoachingInvoice")
    faults = [_fault(ih.isNull(), "invoiceHeader", "missing", "OBJECT", carved),
              _fault(ih.isNotNull() & ~is_object(ih), "invoiceHeader", "model_type", ih, texts["invoiceHeader"])]
    for f in HEADER_FIELDS:
        v = vget(root, f"$.invoiceHeader.{f}")
        faults.append(_fault(is_object(ih) & ~opt_string_ok(v), f"invoiceHeader.{f}", "string_type", v, inner[f]))
    faults += [_fault(coach.isNull(), "isCoachingInvoice", "missing", "OBJECT", carved),
               _fault(coach.isNotNull() & bool_value(coach).isNull(), "isCoachingInvoice", "bool_type",
                      coach, texts["isCoachingInvoice"])]
    return _all(root, carved, faults)


def _item_faults(x: Column, e: Column, raw: Column, i: Column) -> Column:
    """Faults of one line item; ``x`` its facts, ``e`` its VARIANT, ``raw`` its text."""
    path = F.concat(F.lit("clientCases."), i.cast("string"))
    texts = _texts(raw, (*CASE_FIELDS, "durationHours"))

    def at(f: str) -> Column:
        return F.concat(path, F.lit("." + f))

    def value(f: str) -> tuple[Column, Column]:
        return vget(e, f"$.{f}"), texts[f]

    code = x["t_validatedClientCaseNumber"]
    faults = [_fault(~x["is_obj"], path, "model_type", e, raw),
              _fault(x["is_obj"] & code.isNull(), at("validatedClientCaseNumber"), "missing", "OBJECT", raw),
              _fault(code != "STRING", at("validatedClientCaseNumber"), "string_type", *value("validatedClientCaseNumber"))]
    for f in CASE_FIELDS[1:]:
        faults.append(_fault(~x[f"t_{f}"].isin("VOID", "STRING"), at(f), "string_type", *value(f)))
    faults.append(_fault((x["t_hours"] != "VOID") & x["hours"].isNull(), at("durationHours"), "float_type", *value("durationHours")))
    return F.array_compact(F.array(*faults))


def lines_faults(root: Column, carved: Column, facts: Column) -> Column:
    """Faults of a line-item answer; ``facts`` its ``item_facts``."""
    cc, na = vget(root, "$.clientCases"), vget(root, "$.clientCasesNoActivity")
    whole = _texts(carved, ("clientCases", "clientCasesNoActivity"))
    parts = F.from_json(carved, "struct<clientCases:array<string>,clientCasesNoActivity:array<string>>")
    items = F.try_variant_get(root, "$.clientCases", "array<variant>")
    names = F.try_variant_get(root, "$.clientCasesNoActivity", "array<variant>")
    faults = [_fault(cc.isNotNull() & ~is_array(cc), "clientCases", "list_type", cc, whole["clientCases"]),
              _fault(na.isNotNull() & ~is_array(na), "clientCasesNoActivity", "list_type",
                     na, whole["clientCasesNoActivity"])]
    of_items = F.flatten(F.transform(facts, lambda x, i: _item_faults(x, F.get(items, i), F.get(parts["clientCases"], i), i)))
    of_names = F.array_compact(F.transform(names, lambda v, i: _fault(
        vtype(v) != "STRING", F.concat(F.lit("clientCasesNoActivity."), i.cast("string")), "string_type",
        v, F.get(parts["clientCasesNoActivity"], i))))
    none = F.array().cast(f"array<{_FAULT}>")
    return F.concat(_all(root, carved, faults), F.coalesce(of_items, none), F.coalesce(of_names, none))


def may_quote(carved: Column, marks: tuple[str, ...]) -> Column:
    """Whether the message of a failed answer can hold one of ``marks`` (texts or whole numbers
    from 100, lower-case) at all; a cheap test before ``message_words``. False only where it cannot.

    The message holds the answer's own characters, but for escapes, numbers printed in another
    form (exponents, many digits, a shifted point) and counts or positions of list entries, which
    take two characters each.
    """
    entries = min(int(m) for m in marks if m.isdigit())
    other_form = r"\\|[0-9.]e[-+]?[0-9]|[0-9]{7,}[.]|[0-9.]{15,}"
    return (F.length(carved) >= 2 * entries - 8) | F.lower(carved).rlike("|".join((*marks, other_form)))


def message_words(faults: Column) -> Column:
    """The parts of the message that depend on the answer: how many faults, their paths, and
    the values at fault as shown. (Line and column of a JSON fault are not rebuilt.)"""
    def shown(s: Column) -> Column:
        return F.when(F.length(s) > SHOWN_CHARS, F.concat(F.left(s, F.lit(SHOWN_HEAD)), F.lit("..."), F.right(s, F.lit(SHOWN_TAIL))))\
            .otherwise(s)

    printed = F.transform(faults, lambda f: value_repr(f["type"], f["text"]))
    return F.concat(F.array(F.size(faults).cast("string")), F.transform(faults, lambda f: f["path"]), F.transform(printed, shown))
