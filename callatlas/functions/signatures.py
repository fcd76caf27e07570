"""Column functions over method signatures `<class: return name(params)>` and class names. No UDFs: all of it is codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JVM descriptor letters.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}
SIGNATURE = r"^<([^:]+): (\S+) ([^(\s]+)\(([^)]*)\)>$"
#: Prefixes of platform code.
FRAMEWORK_PREFIXES = ("android.", "androidx.", "java.", "javax.", "kotlin.", "dalvik.")


def _first(text: Column, pattern: str, group: int) -> Column:
    """A group, that cannot be empty, of the first match, else null. nullif would try the pattern twice."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def _part(signature: Column, group: int) -> Column:
    return _first(F.trim(signature), SIGNATURE, group)


def class_of(signature: Column) -> Column:
    """Class of a signature; a text that is none is taken for the class itself, up to its first colon."""
    inner = F.regexp_replace(F.trim(signature), "^<|>$", "")
    return F.coalesce(_part(signature, 1), F.trim(F.substring_index(inner, ":", 1)))


def return_of(signature: Column) -> Column:
    return _part(signature, 2)


def method_of(signature: Column) -> Column:
    return F.coalesce(_part(signature, 3), _first(signature, r"([^\s.(:]+)\(", 1))


def params_of(signature: Column) -> Column:
    """Parameter types as an array, empty for none, null if this is no signature."""
    inner = F.regexp_extract(F.trim(signature), SIGNATURE, 4)
    types = F.transform(F.split(inner, ","), lambda t: F.trim(t))
    return F.when(F.trim(signature).rlike(SIGNATURE), F.filter(types, lambda t: F.length(t) > 0))


def outer_class(name: Column) -> Column:
    return F.substring_index(name, "$", 1)


def package_of(name: Column) -> Column:
    """Package of a class; empty for the default package."""
    return F.regexp_extract(outer_class(name), r"^(.*)\.[^.]*$", 1)


def descriptor_type(descriptor: Column) -> Column:
    """Type of a JVM descriptor: [[I is int[][], Lcom/a/B; is com.a.B."""
    dims = F.length(F.regexp_extract(descriptor, r"^(\[*)", 1))
    base = F.regexp_replace(descriptor, r"^\[*", "")
    plain = F.when(base.rlike("^L.*;$"), F.translate(F.substring(base, F.lit(2), F.length(base) - 2), "/", ".")).otherwise(base)
    for letter, name in PRIMITIVES.items():
        plain = F.when(base == letter, name).otherwise(plain)
    return F.concat(plain, F.repeat(F.lit("[]"), dims))


def normalise_signature(owner: Column, name: Column, descriptor: Column) -> Column:
    """(Lcom/a/B;, run, (I[J)V) as <com.a.B: void run(int,long[])>; a descriptor that is already a signature stays."""
    args = F.regexp_extract_all(F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1), F.lit(r"\[*(?:L[^;]+;|[VZBSCIJFD])"), F.lit(0))
    made = F.concat(F.lit("<"), descriptor_type(owner), F.lit(": "), descriptor_type(F.regexp_extract(descriptor, r"\)(.*)$", 1)), F.lit(" "), name,
                    F.lit("("), F.array_join(F.transform(args, descriptor_type), ","), F.lit(")>"))
    return F.when(descriptor.startswith("<"), descriptor).otherwise(made)


def is_framework_name(name: Column) -> Column:
    out = F.lit(False)
    for prefix in FRAMEWORK_PREFIXES:
        out = out | name.startswith(prefix)
    return out


def component_name(name: Column, package: Column) -> Column:
    """.Main and Main belong to the package, a.b.Main stays."""
    return F.when(name.startswith("."), F.concat(package, name)).when(~name.contains("."), F.concat(package, F.lit("."), name)).otherwise(name)


def sha1_id(prefix: str, *parts: Column, length: int | None = None) -> Column:
    """prefix + sha1 of the parts joined by |."""
    digest = F.sha1(F.concat_ws("|", *parts))
    return F.concat(F.lit(prefix), F.substring(digest, 1, length) if length else digest)


def priority_rank(priority: Column, unknown: int = 99) -> Column:
    return F.when(priority == "CRITICAL", 1).when(priority == "HIGH", 2).when(priority == "MEDIUM", 3).when(priority == "LOW", 4).otherwise(unknown)
