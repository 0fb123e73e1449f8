
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scores, text
from ..functions.similarity import name_similarity
from ..operators import battery, drift, graph, groups, pairs, sets
from ..sources.code import Facts


def _at() -> Column:
    return F.concat_ws(":", "file", F.col("line").cast("string"))


def _last(c: str) -> Column:
    return F.regexp_replace(text.last_segment(F.col(c)), r"^\.|!$", "")


def inventory(f: Facts, kind: str | None = None, vis: str | None = None, name: str | None = None) -> DataFrame:
    """F1, F2."""
    d = f.defns.withColumn("loc", F.col("end") - F.col("line") + 1)
    d = d.where(F.col("kind") == kind) if kind else d
    d = d.where(F.col("vis").startswith(vis) if vis == "pub" else F.col("vis") == vis) if vis else d
    d = d.where(text.glob_like(F.col("qpath"), name)) if name else d
    return d.select("kind", "vis", "loc", "qpath", "file", "line").orderBy("kind", "qpath", "file", "line")


def show(f: Facts, names: list[str], part: str = "full", max_lines: int = 240) -> DataFrame:
    """source lines of named items."""
    lo, hi = {"full": ("doc_start", "end"), "sig": ("line", "line"), "span": ("line", "end"), "doc": ("doc_start", "line")}[part]
    wanted = reduce(Column.__or__, [(F.col("qpath") == n) | F.col("qpath").endswith(f"::{n}") for n in names])
    d = f.defns.where(wanted).select("qpath", F.col("file").alias("_f"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    return d.join(f.lines, (F.col("_f") == F.col("file")) & F.col("line").between(F.col("_lo"), F.least(F.col("_hi"), F.col("_lo") + max_lines - 1))).select("qpath", "file", "line", "text").orderBy("qpath", "file", "line")


def outline(f: Facts, path: str) -> DataFrame:
    """items of files whose path ends with the given components."""
    return f.defns.where((F.col("file") == path) | F.col("file").endswith(f"/{path}")).select("file", "line", "depth", "kind", "vis", "name").orderBy("file", "line")


def at(f: Facts, path: str, line: int) -> DataFrame:
    """Items around a line, outermost first."""
    return f.defns.where(((F.col("file") == path) | F.col("file").endswith(f"/{path}")) & F.lit(line).between(F.col("doc_start"), F.col("end"))).select("kind", "vis", "name", "qpath", "line", "end").orderBy(F.desc(F.col("end") - F.col("line")), "line")


def impls(f: Facts, of: str | None = None, trait: str | None = None) -> DataFrame:
    """F6."""
    d = f.defns.where("kind = 'impl'")
    d = d.where(F.col("name") == of) if of else d
    d = d.where(text.last_segment(F.regexp_replace("trait_name", "<.*", "")) == trait) if trait else d
    return d.select("trait_name", "name", "qpath", _at().alias("at"))


def callers(f: Facts, query: str, min_confidence: str = "heuristic") -> DataFrame:
    """Sites that call a name, with confidence: through the imports of their file a written head is resolved first."""
    heads = f.uses.where("alias IS NOT NULL").select("file", F.col("alias").alias("_head"), "path").dropDuplicates(["file", "_head"])
    sites = f.call_sites.withColumn("_head", F.substring_index("target", "::", 1)).join(heads, ["file", "_head"], "left")
    resolved = F.when(F.col("path").isNotNull(), F.concat("path", F.expr("substr(target, length(_head) + 1)"))).otherwise(F.col("target"))
    sites = sites.withColumn("resolved", resolved).withColumn("name", _last("target"))
    last, bare = query.split("::")[-1].lstrip(".").rstrip("!"), "::" not in query
    hit = F.col("name") == last
    if query.startswith("."):
        hit = hit & F.col("target").startswith(".")
    elif query.endswith("!"):
        hit = hit & F.col("target").endswith("!")
    unique = f.defns.where((F.col("name") == last) & (F.col("kind") == "fn")).count() == 1
    exact = F.lit(unique) if bare else (F.col("resolved") == query) | F.col("resolved").endswith("::" + query) | F.lit(query).endswith(F.concat(F.lit("::"), F.col("resolved")))
    rank = F.when(F.col("shadowed"), 0).when(exact, 2).when(F.lit(not bare) & ~F.col("target").startswith("."), -1).otherwise(0)
    names = F.element_at(F.array(*[F.lit(x) for x in ("heuristic", "inferred", "resolved", "exact")]), F.col("_rank") + 1)
    least = ["heuristic", "inferred", "resolved", "exact"].index(min_confidence)
    return sites.where(hit).withColumn("_rank", rank).where(f"_rank >= {least}").select("caller", "target", names.alias("confidence"), _at().alias("at")).orderBy("caller", "at")


def callers_transitive(f: Facts, name: str, depth: int | None = None) -> DataFrame:
    """G1: who reaches a name, by last segments, at the first depth."""
    edges = f.call_sites.select(_last("target").alias("src"), text.last_segment(F.col("caller")).alias("dst"))
    return graph.reach(edges, f.spark.createDataFrame([(name,)], "node string"), depth).where("depth > 0")


def callers_by(f: Facts, query: str, level: str = "file") -> DataFrame:
    """A1."""
    key = {"fn": F.col("caller"), "file": F.regexp_extract("at", "^(.*):", 1), "module": text.module_of(F.col("caller"))}[level]
    return callers(f, query).groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def callers_among(f: Facts, query: str, cohort: str) -> DataFrame:
    """Members of a cohort with their first call, if any."""
    members = f.defns.where((F.col("kind") == "fn") & text.glob_like(F.col("qpath"), cohort)).select(F.col("qpath").alias("caller"))
    return members.join(callers(f, query).groupBy("caller").agg(F.min("at").alias("at")), "caller", "left").orderBy("caller")


def callees(f: Facts, fn: str) -> DataFrame:
    """F7."""
    return f.call_sites.where((F.col("caller") == fn) | F.col("caller").endswith(f"::{fn}")).groupBy("target").agg(F.count("*").alias("n"), F.min(_at()).alias("at")).orderBy(F.desc("n"), "target")


def co_call(f: Facts, a: str, b: str) -> DataFrame:
    """J16."""
    return groups.one_side_or_both(f.call_sites, "caller", _last("target") == a, _last("target") == b)


def cohort_callees(f: Facts, pattern: str) -> DataFrame:
    """A9."""
    s = f.call_sites.where(text.glob_like(F.col("caller"), pattern)).select("caller", _last("target").alias("callee"))
    return groups.presence_matrix(s, "caller", "callee")


def fields(f: Facts, name: str | None = None) -> DataFrame:
    """F8: fields with how often they are read and written, by one aggregate over all references."""
    d = f.defns.where("kind = 'struct'").select("file", F.col("name").alias("type"), F.explode("fields").alias("x")).select("type", "x.vis", F.col("x.name").alias("field"), F.col("x.type").alias("field_type"), "file", "x.line")
    d = d.where(F.col("type") == name) if name else d
    refs = f.field_refs.where("type IS NOT NULL").groupBy("type", "field").agg(F.count(F.when(F.col("kind") == "read", 1)).alias("reads"), F.count(F.when(F.col("kind") == "write", 1)).alias("writes"))
    inits = f.literals.select("type", F.explode(F.concat(F.map_keys("fields"), "computed")).alias("field")).groupBy("type", "field").agg(F.count("*").alias("inits"))
    return d.join(refs, ["type", "field"], "left").join(inits, ["type", "field"], "left").fillna(0, ["reads", "writes", "inits"])


def field_uses(f: Facts, type_name: str, field: str, candidates: bool = False) -> DataFrame:
    """F9."""
    r = f.field_refs.where(F.col("field") == field)
    return r.where((F.col("type") == type_name) | (F.lit(candidates) & F.col("type").isNull())).select("kind", "via", "receiver", "in_fn", _at().alias("at"))


def type_refs(f: Facts, name: str) -> DataFrame:
    """References to a type or any alias of it."""
    same = graph.synonyms(f.defns.where("kind = 'type'").select(F.col("name").alias("alias"), F.regexp_extract("qpath", r"([^:]*)$", 1).alias("target")).unionByName(f.uses.where("alias IS NOT NULL").select("alias", text.last_segment(F.col("path")).alias("target"))).where("alias <> target"), name)
    return f.type_refs.join(same.withColumnRenamed("node", "type"), "type").select("role", F.col("type").alias("written"), "in_fn", _at().alias("at"))


def takes_mut(f: Facts, name: str | None = None) -> DataFrame:
    """functions that take `&mut T`, or how many there are for each T."""
    p = f.defns.where("kind = 'fn'").select("qpath", "file", "line", F.explode("params").alias("p")).withColumn("type", F.regexp_extract("p", r"&(?:'\w+ ?)?mut ?(\w+)", 1)).where("type NOT IN ('', 'self')")
    return p.where(F.col("type") == name).select("qpath", "p", _at().alias("at")) if name else p.groupBy("type").agg(F.countDistinct("qpath").alias("mut_fns")).orderBy(F.desc("mut_fns"), "type")


def variants(f: Facts, enum: str | None = None) -> DataFrame:
    """F12."""
    d = f.defns.where("kind = 'enum'").select(F.lit("def").alias("kind"), F.col("name").alias("enum"), F.explode("variants").alias("variant"), F.col("qpath").alias("in_fn"), _at().alias("at"))
    s = f.dispatch_sites.select(F.lit("match").alias("kind"), "enum", F.explode("variants").alias("variant"), F.col("context").alias("in_fn"), _at().alias("at"))
    out = d.unionByName(s)
    return out.where(F.col("enum") == enum) if enum else out


def catch_all_arms(f: Facts, enum: str | None = None) -> DataFrame:
    """F13."""
    s = f.dispatch_sites.where("wildcard AND size(variants) > 0")
    return (s.where(F.col("enum") == enum) if enum else s).select("enum", "context", F.array_join("variants", ",").alias("variants"), _at().alias("at"))


def _dispatch(f: Facts) -> DataFrame:
    return f.dispatch_sites.withColumn("site", F.concat("context", F.lit("@"), _at()))


def parallel_matches(f: Facts) -> DataFrame:
    """A10."""
    return sets.parallel_sets(_dispatch(f))


def enum_coverage(f: Facts) -> DataFrame:
    """C12, J14."""
    defs = f.defns.where("kind = 'enum'").select(F.col("name").alias("enum"), F.concat_ws(":", "file", "line").alias("def_id"), "variants")
    return sets.coverage(_dispatch(f).select("enum", "site", "variants"), defs)


def rank_enums(f: Facts) -> DataFrame:
    """A11."""
    return sets.worst_gaps(enum_coverage(f))


def divergence(f: Facts, least: float = 0.25) -> DataFrame:
    """C11, J8, W1."""
    partial = enum_coverage(f).select("enum", "site")
    return pairs.lean_and_rich(_dispatch(f).join(partial, ["enum", "site"]).withColumn("ord", _at()), least)


def casts(f: Facts, cls: str | None = None) -> DataFrame:
    """F14, X23."""
    return (f.casts.where(F.col("cls") == cls) if cls else f.casts.where("cls <> 'usize-widen'")).select("cls", "src", "dst", "in_fn", _at().alias("at"))


def sites(f: Facts, family: str, kind: str | None = None) -> DataFrame:
    """Conversions, stringly comparisons or assertions."""
    s = f.sites.where(F.col("family") == family)
    return (s.where(F.col("kind") == kind) if kind else s).select("kind", "detail", "in_fn", _at().alias("at"))


_VERBS = {"mutation": "write|save|insert|remove|delete|push|set|update|send|commit|create|rename|flush", "io": "open|read|connect|fetch|load|recv|spawn|fs|net", "decode": "parse|from_str|decode|deserialize|from_utf8|to_str|try_into|try_from"}


def _effect(detail: Column) -> Column:
    out = F.lit("unknown")
    for name in ("decode", "io", "mutation"):
        out = F.when(detail.rlike(rf"\b(?:{_VERBS[name]})(?:_\w+)?\b"), name).otherwise(out)
    return out


def error_swallows(f: Facts, least: float = 0.0) -> DataFrame:
    """F19, X19, X20."""
    s = f.sites.where("family = 'swallow'").withColumn("effect", _effect(F.col("detail"))).withColumn("benign", text.looks_like_logging(F.col("detail")) | F.col("detail").rlike(r"^write!|\.get\("))
    return s.withColumn("score", F.round(scores.error_swallows(F.col("kind"), F.col("effect"), F.col("benign"), F.lit(False)), 6)).where(F.col("score") >= least).select("kind", "score", "effect", "benign", "in_fn", _at().alias("at"))


def panics(f: Facts, least: float = 0.0) -> DataFrame:
    """F20."""
    s = f.sites.where("family = 'panic'").withColumn("effect", _effect(F.col("detail"))).withColumn("benign", F.col("detail").rlike(r"\.lock\(|\.read\(\)$|\.write\(\)$"))
    return s.withColumn("score", F.round(scores.panics(F.col("kind"), F.col("effect"), F.col("benign"), F.col("detail").rlike(r'^"|^\d')), 6)).where(F.col("score") >= least).select("kind", "score", "effect", "benign", "in_fn", _at().alias("at"))


def metrics(f: Facts, min_cyclo: int = 0) -> DataFrame:
    """A4."""
    return f.bodies.withColumn("loc", F.col("end") - F.col("line") + 1).where(F.col("cyclo") >= min_cyclo).select("qpath", "loc", "params", "cyclo", "nesting", _at().alias("at")).orderBy(F.desc("loc"), "qpath")


def dead_code(f: Facts, transitive: bool = False, include_trait_impls: bool = False) -> DataFrame:
    """Functions that no call, path, import or attribute names. The calls of all files count, tests too."""
    fns = f.defns.where("kind = 'fn' AND NOT is_test AND NOT allow_dead AND name NOT IN ('main', 'start')")
    fns = fns if include_trait_impls else fns.where("trait_name IS NULL")
    calls = f.call_sites.select(text.last_segment(F.col("caller")).alias("caller"), _last("target").alias("target"))
    named = f.uses.select(F.lit(None).cast("string").alias("caller"), text.last_segment(F.col("path")).alias("target")).unionByName(f.defns.select(F.lit(None).cast("string").alias("caller"), F.explode("attrs").alias("a")).select("caller", F.explode(F.expr(r"regexp_extract_all(a, '\\w+', 0)")).alias("target")))
    dead = graph.transitively_unused(fns, calls.where("caller <> target").unionByName(named), 16 if transitive else 1)
    return fns.join(dead, "name").select("round", "vis", "qpath", _at().alias("at"))


def conversion_pairs(f: Facts) -> DataFrame:
    """J6."""
    i = f.defns.where("kind = 'impl' AND trait_name RLIKE '^(Try)?From<'").select(F.regexp_extract("trait_name", r"^(\w+)<", 1).alias("trait"), F.regexp_extract("trait_name", r"<&?(.*)>$", 1).alias("src"), F.col("sig").alias("dst"), _at().alias("at"))
    return pairs.mutual(i, ["trait"], "src", "dst", "at")


def pass_through(f: Facts, max_loc: int = 1) -> DataFrame:
    """F17."""
    return f.bodies.withColumn("loc", F.greatest(F.lit(1), F.col("end") - F.col("line") - 1)).where((F.col("forwards").isNotNull()) & (F.col("loc") <= max_loc)).select("qpath", F.col("forwards").alias("forwards_to"), "loc", _at().alias("at"))


def clones(f: Facts, min_tokens: int = 24) -> DataFrame:
    """A2."""
    b = f.bodies.withColumn("body", F.concat_ws("\u0001", "skeleton", F.array_join("leaves", "\u0002"))).withColumn("dir", text.dir_of(F.col("file"))).withColumn("at", F.concat("qpath", F.lit("@"), _at()))
    return groups.copies(b, "body", "name", "dir", F.col("tokens"), "at", min_tokens)


def near_clones(f: Facts, min_tokens: int = 24, max_diff: int = 2) -> DataFrame:
    """Pairs of bodies of one skeleton, of any number, whose leaves differ in one to max_diff places.

    Bodies of one skeleton have equally many leaves; those of a pair agree in one of max_diff + 1 blocks of them at least, by which they meet.
    """
    b = f.bodies.where(F.col("tokens") >= min_tokens).withColumn("at", F.concat("qpath", F.lit("@"), _at())).withColumn("skeleton", F.sha2("skeleton", 256))
    cut = f"CAST(floor(size(leaves) * {{}} / {max_diff + 1}) AS INT)"
    blocks = ", ".join(f"struct({k} AS k, xxhash64(slice(leaves, {cut.format(k)} + 1, {cut.format(k + 1)} - {cut.format(k)})) AS v)" for k in range(max_diff + 1))
    b = b.withColumn("_block", F.explode(F.expr(f"array({blocks})")))
    x, y = (b.select("skeleton", "_block", F.col("at").alias(k), F.col("leaves").alias(f"_{k}"), F.col("name").alias(f"{k}_name"), text.dir_of(F.col("file")).alias(f"{k}_dir"), "tokens", F.col("in_trait_impl").alias(f"{k}_trait")) for k in "ab")
    edges = x.join(y.drop("tokens"), ["skeleton", "_block"]).where("a < b").withColumn("diffs", F.size(F.filter(F.zip_with("_a", "_b", lambda p, q: ~p.eqNullSafe(q)), lambda d: d))).where(f"diffs BETWEEN 1 AND {max_diff}")
    edges = edges.dropDuplicates(["skeleton", "a", "b"])
    score = scores.near_clones(F.col("diffs"), max_diff, F.col("tokens"), F.col("a_name") == F.col("b_name"), F.col("a_dir") == F.col("b_dir"), F.col("a_trait") & F.col("b_trait"))
    return edges.select("skeleton", "a", "b", "diffs", "tokens", F.round(score, 6).alias("score"))


def concepts(f: Facts, least: float = 0.35) -> DataFrame:
    """Structs of one field type that share a word of their names."""
    d = f.defns.where("kind = 'struct' AND size(fields) = 1").withColumn("inner", F.col("fields")[0]["type"]).withColumn("key", F.concat_ws("@", "qpath", _at()))
    return groups.word_concepts(d, ["inner"], F.col("name"), "key", F.col("vis").startswith("pub"), F.col("module"), least)


def doc_drift(f: Facts, names: bool = False) -> DataFrame:
    """F21, J19."""
    d = f.defns.where("kind = 'fn'").withColumn("doc", F.coalesce("doc", F.lit("")))
    panic = f.sites.where("family = 'panic'").select(F.col("in_fn").alias("qpath"), "file").distinct().withColumn("_p", F.lit(True))
    d = d.join(panic, ["qpath", "file"], "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    says, errs = F.col("doc").rlike(r"(?im)^#+ *Panics"), F.col("doc").rlike(r"(?im)^#+ *Errors")
    fallible = F.col("ret").rlike(r"^(Result|Option)|Result<")
    kinds = F.filter(F.array(F.when(says & ~F.col("_p"), "panics-doc-unbacked"), F.when(~says & F.col("_p") & (F.col("doc") != ""), "panics-undocumented"), F.when(errs & ~fallible, "errors-doc-unbacked")), lambda k: k.isNotNull())
    out = d.select(F.explode(kinds).alias("kind"), "qpath", _at().alias("at"), F.lit("").alias("detail"))
    if names:
        words = d.select("qpath", "file", "line", "params", F.explode(F.expr(r"regexp_extract_all(doc, '`([A-Za-z_]\\w{0,39})`', 1)")).alias("detail"))
        known = f.defns.select(F.col("name").alias("detail")).union(f.defns.select(F.explode("variants"))).union(f.bodies.select(F.explode("idents"))).union(f.defns.select(F.explode(F.expr(r"flatten(transform(params, p -> regexp_extract_all(p, '\\w+', 0)))"))))
        out = out.unionByName(words.join(known.distinct(), "detail", "left_anti").select(F.lit("stale-name").alias("kind"), "qpath", _at().alias("at"), "detail"))
    return out.withColumn("score", scores.doc_drift(F.col("kind")))


def config_drift(f: Facts, least: float = 0.05) -> DataFrame:
    """A5: constant fields of struct literals vote; computed ones abstain, and `..` stands for the default."""
    lit = f.literals.withColumn("site", F.concat_ws("@", "context", _at())).withColumn("module", text.module_of(F.col("context")))
    known = lit.select("type", F.explode(F.map_keys("fields")).alias("field")).distinct()
    votes = lit.join(known, "type").withColumn("vote", F.coalesce(F.element_at("fields", F.col("field")), F.when(F.col("has_rest") & ~F.array_contains("computed", F.col("field")), F.lit("(default)"))))
    per_site = votes.groupBy("type", "site", "module").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field", F.coalesce("vote", F.lit("?"))))), "\u0001").alias("config"))
    shape = per_site.groupBy("type").agg(F.count("*").alias("sites"), F.countDistinct("config").alias("configs"), F.countDistinct("module").alias("modules"))
    judged = votes.where("NOT field IN ('name', 'id', 'label', 'title', 'key')").groupBy("type", "field").agg(F.count("vote").alias("n"), F.min("vote").alias("lo"), F.max("vote").alias("hi")).where("n >= 2")
    fields_ = judged.groupBy("type").agg(F.count(F.when(F.expr("lo = hi"), 1)).alias("agreed"), F.array_sort(F.collect_list(F.when(F.expr("lo <> hi"), F.col("field")))).alias("differs")).withColumn("differing", F.size("differs")).where("differing > 0")
    out = shape.join(fields_, "type")
    score = scores.config_drift(F.col("agreed"), F.col("differing"), F.col("configs"), F.col("modules"), F.col("sites"))
    return out.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).select("type", "score", "sites", "configs", "agreed", F.array_join("differs", ",").alias("differs"))


def builder_drift(f: Facts, least: float = 0.05) -> DataFrame:
    """A6."""
    c = f.chains.withColumn("root", F.concat("root", F.lit("("), "root_args", F.lit(")"))).withColumn("chain", _at())
    total = c.groupBy("root").agg(F.count("*").alias("chains"), F.countDistinct("context").alias("fns"), F.countDistinct("file").alias("files"), F.min_by("chain", F.struct(F.size("methods"), F.col("chain"))).alias("leanest"), F.max_by("chain", F.struct(F.size("methods"), F.col("chain"))).alias("richest")).where("chains > 1")
    steps = c.select("root", F.explode("methods").alias("m")).groupBy("root", "m").agg(F.count("*").alias("n"))
    g = steps.join(total, "root").groupBy("root", "chains", "fns", "files", "leanest", "richest").agg(F.count(F.when(F.expr("n = chains"), 1)).alias("shared"), F.array_sort(F.collect_list(F.when(F.expr("n < chains"), F.col("m")))).alias("differs")).where("size(differs) > 0")
    score = scores.builder_drift(F.col("shared"), F.size("differs"), F.expr("CASE WHEN fns = 1 THEN 1.0D WHEN files = 1 THEN 0.6D ELSE 0.35D END"))
    return g.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).select("root", "score", "chains", "shared", F.array_join("differs", ",").alias("differs"), "leanest", "richest")


def arith_drift(f: Facts, least: float = 0.5) -> DataFrame:
    """A7, J11."""
    s = f.arith_sites
    g = drift.ratio_groups(s, ["file", "scope", "op"], F.col("checked"), least)
    near = pairs.nearest(s.where("NOT checked"), s.where("checked"), ["file", "scope", "op"], "line", "spelling")
    return g.join(near, ["file", "scope", "op"]).select("op", "score", "checked", "raw", "scope", _at().alias("at"), F.col("near_line").alias("vs_line"))


def validation_drift(f: Facts, least: float = 0.0) -> DataFrame:
    """Functions of one scope that share a word, some of which assert."""
    ok = f.sites.where("family = 'assert'").select(F.col("in_fn").alias("qpath")).distinct().withColumn("_ok", F.lit(True))
    d = f.defns.where("kind = 'fn' AND NOT is_test").join(ok, "qpath", "left").withColumn("scope", text.module_of(F.col("qpath"))).withColumn("word", F.explode(F.filter(text.words_of(F.col("name")), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(text.GENERIC)))))
    return drift.validation_drift(d, [["scope", "word"]], "qpath", F.coalesce("_ok", F.lit(False)), least)


def module_uses(f: Facts, module: str) -> DataFrame:
    """Imports of a module's items from outside it."""
    inside = (F.col("path") == module) | F.col("path").endswith(f"::{module}") | F.col("path").contains(f"{module}::")
    own = F.col("file").rlike(rf"(^|/){module.replace('::', '/')}(\.rs|/)")
    return f.uses.where(inside & ~own).select("file", "line", "path", "alias")


def tests(f: Facts, mentions: str | None = None) -> DataFrame:
    """F22."""
    t = f.defns.where("kind = 'fn' AND exists(attrs, a -> a = 'test' OR a LIKE '%::test')")
    if mentions:
        t = t.join(f.bodies.where(F.array_contains("idents", mentions)).select("qpath", "file"), ["qpath", "file"], "left_semi")
    return t.select("qpath", _at().alias("at"), "line", "end")


def near_names(f: Facts, query: str, top: int = 6) -> DataFrame:
    """For a name that nothing has."""
    d = f.defns.where("name <> ''").groupBy("name").agg(F.min(_at()).alias("at"))
    return d.withColumn("similarity", F.round(name_similarity(F.lower("name"), F.lit(query.lower())), 6)).where("similarity >= 0.6").orderBy(F.desc("similarity"), "name").limit(top)


def blind_spots(f: Facts) -> DataFrame:
    """Files without facts, and macros whose bodies are read only as tokens."""
    macros = f.defns.where("kind = 'macro_rules'").select("file", F.concat(F.lit("macro "), "name").alias("reason"))
    return f.bad.select("file", "reason").unionByName(macros).distinct()


def oracle_calls(f: Facts, name: str) -> DataFrame:
    """Lines that call a name by the look of their text alone, without the parser: what callers() should not miss."""
    plain = F.regexp_replace(F.regexp_replace("text", r'"(?:\\.|[^"\\])*"', '""'), "//.*$", "")
    return f.lines.withColumn("plain", plain).where(F.col("plain").rlike(rf"\b{name}(?:::<[^>]*>)?\s*\(") & ~F.col("plain").rlike(rf"\bfn\s+{name}\b")).select("file", "line")


def contract_candidates(f: Facts, min_callers: int = 3) -> DataFrame:
    """C7, A13."""
    fns = f.defns.where("kind = 'fn' AND NOT is_test").select("name", (F.col("end") - F.col("line") + 1).alias("loc"), F.regexp_extract("ret", r"^(Result|Option)", 1).alias("ret"), F.col("owner").isNull().alias("free"), F.col("doc").isNotNull().alias("documented"))
    calls = f.call_sites.where("NOT target LIKE '.%' AND NOT target LIKE '%!'").select(_last("target").alias("callee"), "caller", text.module_of(F.col("caller")).alias("module"))
    return battery.contract_candidates(fns, calls, min_callers)


CHECKS = {
    "clones": lambda f: clones(f).select("label", F.col("first").alias("site"), "score"),
    "near-clones": lambda f: near_clones(f).select(F.concat_ws(" | ", "a", "b").alias("label"), F.col("a").alias("site"), "score"),
    "concepts": lambda f: concepts(f).select("word", F.col("inner").alias("site"), "score").withColumnRenamed("word", "label"),
    "divergence": lambda f: divergence(f).select(F.concat_ws(" | ", "enum", "missing_here").alias("label"), "site", "score"),
    "config-drift": lambda f: config_drift(f).select(F.col("type").alias("label"), F.col("differs").alias("site"), "score"),
    "builder-drift": lambda f: builder_drift(f).select(F.col("root").alias("label"), F.col("leanest").alias("site"), "score"),
    "arith-drift": lambda f: arith_drift(f).select(F.concat_ws(" | ", "scope", "op").alias("label"), F.col("at").alias("site"), "score"),
    "validation-drift": lambda f: validation_drift(f).select(F.col("key").alias("label"), F.col("cohort").alias("site"), "score"),
    "error-swallows": lambda f: error_swallows(f).select(F.concat_ws(" | ", "in_fn", "kind").alias("label"), F.col("at").alias("site"), "score"),
    "panics": lambda f: panics(f).select(F.concat_ws(" | ", "in_fn", "kind").alias("label"), F.col("at").alias("site"), "score"),
    "doc-drift": lambda f: doc_drift(f).select(F.concat_ws(" | ", "qpath", "kind").alias("label"), F.col("at").alias("site"), "score"),
}


def audit(f: Facts, only: list[str] | None = None, skip: list[str] | None = None, top: int = 25) -> DataFrame:
    """The battery, ranked and capped."""
    chosen = {k: v for k, v in CHECKS.items() if (only is None or k in only) and k not in (skip or [])}
    unknown = sorted({*(only or []), *(skip or [])} - set(CHECKS))
    if unknown:
        raise ValueError(f"no such check: {', '.join(unknown)}; there are {', '.join(CHECKS)}")
    return battery.rank_cap(battery.findings({k: v(f) for k, v in chosen.items()}), top)


def since(now: DataFrame, base: DataFrame) -> DataFrame:
    """Two runs of the battery by fingerprint."""
    return sets.multiset_diff(now, base, ["check", "fp"])


def latest(f: Facts) -> DataFrame:
    """W1 in general: the first item of each name."""
    w = W.partitionBy("name").orderBy("file", "line")
    return f.defns.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
