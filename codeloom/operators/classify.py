"""Labels by ordered rules: roles, risk flags, lifecycle, sensitive zones, risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import is_exported, is_test_file, saturating


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """Label of the first rule that holds."""
    out = F.lit(otherwise)
    for label, rule in reversed(rules):
        out = F.when(rule, label).otherwise(out)
    return out


#: Names of callers that make an entry point, and of callees that make persistence.
STARTERS, SQL_CALLS = ("main", "init"), ("Query", "QueryRow", "Exec", "Begin", "Commit", "Rollback", "Prepare")
#: Call contexts that are risks beside the imports that bear them out.
LOCKS = ("call:Lock", "call:Unlock", "call:RLock", "call:RUnlock", "call:Wait", "call:Do", "call:Add", "call:Done", "call:Store", "call:Load")
PROCESSES = ("call:Command", "call:CommandContext", "call:Run", "call:Start", "call:Output", "call:CombinedOutput")
SERVERS = ("call:ListenAndServe", "call:ListenAndServeTLS", "call:Serve")
#: Weights of roles and of risk flags.
ROLE_WEIGHTS = {"entry_point": 10.0, "api_boundary": 5.0, "persistence": 5.0, "handler": 5.0, "factory": 3.0, "io_primitive": 3.0, "internal": 1.0}
RISK_WEIGHTS = {"security_boundary": 6.0, "concurrency": 5.0}


def call_facts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols with what their calls say: ``started`` (called by main or init), ``sql`` (calls the database), and the
    numbers of calls to them: all, from their own package and from others. A package that is not known is
    neither."""
    own = symbols.select(F.col("id").alias("callee_id"), F.col("pkg_path").alias("_own"))
    ends = symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("_caller"), F.col("pkg_path").alias("_from"), F.lit(True).alias("_known"))
    x = edges.select("caller_id", "callee_id").join(own, "callee_id").join(ends, "caller_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    count = lambda c: F.sum(F.when(flag(c), 1).otherwise(0)).cast("long")
    called = x.groupBy(F.col("callee_id").alias("id")).agg(
        F.bool_or(flag(F.col("_caller").isin(*STARTERS))).alias("started"), F.count(F.lit(1)).alias("n_calls"), count(F.col("_from") == F.col("_own")).alias("n_own"), count(F.col("_from") != F.col("_own")).alias("n_other")
    )
    to = symbols.select(F.col("id").alias("callee_id"), (F.col("name").isin(*SQL_CALLS) | flag(F.lower("pkg_path").contains("database/sql"))).alias("_sql"))
    calling = edges.select("caller_id", "callee_id").join(to.filter("_sql").select("callee_id"), "callee_id", "left_semi").select(F.col("caller_id").alias("id")).distinct().withColumn("sql", F.lit(True))
    out = symbols.join(called, "id", "left").join(calling, "id", "left")
    return out.withColumns({c: flag(F.col(c)) for c in ("started", "sql")} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_calls", "n_own", "n_other")})


def roles(facts: DataFrame) -> DataFrame:
    """Structural role of functions and methods, the first that matches: entry point, handler, input or output,
    factory, persistence, boundary, internal."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    sig, name, package, method = F.lower(text("signature")), text("name"), text("pkg_path"), F.col("kind") == "method"
    result = F.regexp_extract(text("signature"), r"(?s)\)([^)]*)$", 1)  # behind the last bracket
    bytes_of = lambda call: sig.contains(call) & sig.contains("[]byte") & sig.contains("int")
    shown = is_exported(name)
    rules = [
        ("entry_point", ((name == "main") & package.endswith("/main")) | ((name == "RunE") & method) | (name == "init") | F.col("started") | ((name == "Execute") & method)),
        ("handler", sig.contains("servehttp") | (sig.contains("responsewriter") & sig.contains("request")) | sig.contains("*gin.context") | sig.contains("echo.context")),
        ("io_primitive", bytes_of("read(") | bytes_of("write(") | (sig.contains("close()") & sig.contains("error"))),
        ("factory", name.startswith("New") & result.contains("*")),
        ("persistence", F.lower(package).contains("store") | F.col("sql")),
        ("api_boundary", shown & (F.col("n_other") > 0)),
        ("internal", ~shown | (F.col("n_calls") == 0) | (F.col("n_own") == F.col("n_calls"))),
    ]
    return facts.filter(F.col("kind").isin("func", "method")).withColumn("role", first_match(rules, "api_boundary"))


def type_roles(types: DataFrame) -> DataFrame:
    """Role of types: in a store's package, named after readers or writers, exported, internal."""
    low = F.lower(F.coalesce("name", F.lit("")))
    rules = [
        ("persistence", F.lower(F.coalesce("pkg_path", F.lit(""))).contains("store")),
        ("io_primitive", low.contains("reader") | low.contains("writer")),
        ("api_boundary", is_exported(F.coalesce("name", F.lit("")))),
    ]
    return types.filter(F.col("kind").isin("type", "struct", "interface")).withColumn("role", first_match(rules, "internal"))


def risk_flags(symbols: DataFrame, refs: DataFrame, imports: DataFrame) -> DataFrame:
    """``id, concurrency, security_boundary`` of functions and methods. Concurrency: a channel in the signature, a goroutine
    or a channel operation inside, or a call of a lock's name in a file that imports one. Security: a process started,
    a check of certificates left out, a server set up, each beside its import."""
    ctx, snippet = F.coalesce("ast_ctx", F.lit("")), F.coalesce("snippet", F.lit(""))
    any_of = lambda c, name: F.bool_or(c).alias(name)
    skips = F.lower(ctx).contains("insecureskipverify") | F.lower(snippet).contains("insecureskipverify")
    inside = refs.filter(F.col("enclosing_id").isNotNull()).groupBy(F.col("enclosing_id").alias("id")).agg(any_of(ctx.isin("go", "chan"), "_go"), any_of(ctx.isin(*LOCKS), "_lock"), any_of(ctx.isin(*PROCESSES), "_process"), any_of(skips, "_skip"), any_of(ctx.isin(*SERVERS), "_server"))
    package = F.col("pkg_path")
    used = imports.groupBy("file_path").agg(any_of(package.isin("sync", "sync/atomic"), "_sync"), any_of(package == "os/exec", "_exec"), any_of(package == "crypto/tls", "_tls"), any_of(package == "net/http", "_http"))
    x = symbols.filter(F.col("kind").isin("func", "method")).select("id", "file_path", F.coalesce("signature", F.lit("")).rlike(r"(?<![A-Za-z0-9_])chan(?![A-Za-z0-9_])").alias("_chan"))
    x = x.join(inside, "id", "left").join(used, "file_path", "left").na.fill(False)
    both = lambda a, b: F.col(a) & F.col(b)
    return x.select("id", (F.col("_chan") | F.col("_go") | both("_sync", "_lock")).alias("concurrency"), (both("_exec", "_process") | both("_tls", "_skip") | both("_http", "_server")).alias("security_boundary"))


def weight(role: Column, concurrency: Column, security: Column) -> Column:
    """The largest of a role's weight and those of its risk flags."""
    of_role = F.coalesce(*(F.when(role == r, w) for r, w in ROLE_WEIGHTS.items()), F.lit(1.0))
    return F.greatest(of_role, *(F.when(F.coalesce(flag, F.lit(False)), RISK_WEIGHTS[name]).otherwise(0.0) for name, flag in (("concurrency", concurrency), ("security_boundary", security))))


def entry_points(symbols: DataFrame) -> DataFrame:
    """Functions and methods where a program starts: main, then Execute, then the run functions of commands; ``priority``
    1 to 3. Tests stay out. The order is priority, name, file."""
    name, path = F.col("name"), F.col("file_path")
    x = symbols.filter(F.col("kind").isin("func", "method") & ~is_test_file(path))
    x = x.withColumn("priority", F.when(name == "main", 1).when(name == "Execute", 2).when(name.rlike("^run[A-Z]") & path.contains("/cmd/"), 3))
    return x.filter("priority is not null")


def main_files(symbols: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` files named main.go with a main function."""
    bare = F.coalesce("receiver", F.lit("")) == ""
    return symbols.filter((F.col("name") == "main") & (F.col("kind") == "func") & bare & F.col("file_path").endswith("/main.go")).select("file_path").distinct().orderBy("file_path").limit(n)


def lifecycle(uses: DataFrame, owner: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Per owner the labels whose rule holds for any of its rows, in the order of the rules: the first is
    ``primary``; ``mixed`` if there are several."""
    x = uses.groupBy(owner).agg(*(F.bool_or(F.coalesce(rule, F.lit(False))).alias(f"_r{k}") for k, (_, rule) in enumerate(rules)))
    labels = F.array_distinct(F.array_compact(F.array(*(F.when(F.col(f"_r{k}"), label) for k, (label, _) in enumerate(rules)))))
    x = x.withColumn("roles", labels)
    return x.select(owner, F.when(F.size("roles") > 0, F.element_at("roles", 1)).alias("primary"), "roles", (F.size("roles") > 1).alias("mixed"))


def type_lifecycles(refs: DataFrame, symbols: DataFrame, types: DataFrame) -> DataFrame:
    """``symbol_id, enclosing_id, ref_id, role, mixed, is_test``: what each function does with each of ``types (symbol_id,
    type_name)`` that it refers to. The first rule that holds gives the role, other roles are ``mixed``: delete by a call, create
    by a literal, create by name and result, delete by name, mutate by name and parameter; else read. A reference
    outside of functions stands alone (``ref_id``): create by a literal, else type-use. Generated files count as tests."""
    ctx, snippet, quoted = F.coalesce("ast_ctx", F.lit("")), F.coalesce("snippet", F.lit("")), F.concat(F.lit("\\Q"), "type_name", F.lit("\\E"))
    made = ctx.isin("lit", "new", "make")
    call = F.regexp_extract(ctx, "^call:(.*)$", 1)
    gone = ctx.startswith("call:") & ((call == "delete") | call.rlike("^(?:Delete|Remove|Drop|Purge)(?:[A-Z]|$)") | (call.isin("Exec", "ExecContext") & F.upper(snippet).contains("DELETE")))
    base = F.element_at(F.split("file_path", "/"), -1)
    test = F.col("file_path").endswith("_test.go") | F.col("file_path").endswith("_gen.go") | base.startswith("zz_generated_")
    x = refs.withColumn("enclosing_id", F.nullif("enclosing_id", F.lit(""))).join(types, "symbol_id").withColumns({"_gone": gone, "_made": made})

    head = F.min_by(test, F.struct("file_path", "line", "id"))
    groups = x.filter("enclosing_id is not null").groupBy("symbol_id", "type_name", "enclosing_id").agg(F.bool_or("_gone").alias("_gone"), F.bool_or("_made").alias("_made"), head.alias("is_test"))
    inside = symbols.select(F.col("id").alias("enclosing_id"), F.col("name").alias("_fn"), F.coalesce("signature", F.lit("")).alias("_sig"))
    y = groups.join(inside, "enclosing_id", "left")
    fn, sig = F.coalesce("_fn", F.lit("")), F.coalesce("_sig", F.lit(""))
    begins = lambda *verbs: fn.rlike(f"^(?:{'|'.join(verbs)})(?:[A-Z]|$)")
    gives = F.regexp_like(sig, F.concat(F.lit(r"\)\s*(?:\(\s*)?\*?\b"), quoted, F.lit(r"\b")))
    takes = F.regexp_like(sig, F.concat(F.lit(r"\*\s*\b"), quoted, F.lit(r"\b")))
    rules = [("delete", F.col("_gone")), ("create", F.col("_made")), ("create", begins("New", "Make", "Build", "Create") & gives), ("delete", begins("Delete", "Remove", "Archive", "Drop", "Purge")), ("mutate", begins("Set", "Update", "Add", "Append", "Put", "Upsert", "Merge") & takes)]
    found = F.array_distinct(F.array_compact(F.array(*(F.when(rule, label) for label, rule in rules))))
    y = y.withColumn("_l", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("read"))))
    functions = y.select("symbol_id", "enclosing_id", F.lit(None).cast("string").alias("ref_id"), F.element_at("_l", 1).alias("role"), F.slice("_l", 2, 9).alias("mixed"), "is_test")
    bare = x.filter("enclosing_id is null").select("symbol_id", "enclosing_id", F.col("id").alias("ref_id"), F.when(F.col("_made"), "create").otherwise("type-use").alias("role"), F.array().cast("array<string>").alias("mixed"), test.alias("is_test"))
    return functions.unionByName(bare)


#: Zones and the words in a path that mark them.
ZONES = {
    "auth": ("auth", "login", "session", "oauth", "jwt", "credential"),
    "crypto": ("crypto", "cipher", "encrypt", "decrypt", "x509", "tls"),
    "migration": ("migration", "migrate", "schema"),
    "secret": ("secret", "password", "apikey", "vault", "token"),
    "payment": ("payment", "billing", "invoice", "charge"),
}


def zones(text: Column, words: dict[str, tuple[str, ...]] | None = None, extra: dict[str, str] | None = None) -> Column:
    """Sorted zones of a path or text: those with a word that it contains, case aside, and those of extra
    patterns (zone -> regular expression)."""
    low = F.lower(text)
    found = []
    for zone, keys in (words or ZONES).items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        found.append(F.when(hit, zone))
    found += [F.when(text.rlike(p), zone) for zone, p in (extra or {}).items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


#: The counts that score a half.
MIDS = {"callers": 20, "importers": 5, "cyclo": 10, "cognitive": 15, "bug_commits": 5, "churn": 10, "flags": 1, "roles": 3, "exported": 3}


def assessed(measures: DataFrame) -> DataFrame:
    """``measures`` of changes with their five factors and their ``score``, the mean of those that are present, all with
    three decimals. Counts: ``callers, importers, flags, roles`` (other than internal), ``exported, changed_funcs, untested``.
    ``pkg_rank`` of ``pkg_count`` is left out where null; without ``cyclo`` and ``cognitive`` there is no difficulty, without
    ``bug_commits`` and ``churn`` no history, without changed functions no safety net. Where ``degraded`` says why a change
    could not be measured, all are null."""
    curve = lambda name: saturating(F.col(name).cast("double"), MIDS[name])
    mean = lambda *xs: sum(xs[1:], xs[0]) / len(xs)
    share = (F.col("pkg_count") - F.col("pkg_rank") + 1) / F.nullif(F.col("pkg_count"), F.lit(0))
    three = lambda x: F.floor(x * 1000 + 0.5) / 1000
    factors = {
        "reach": F.when(share.isNotNull(), mean(curve("callers"), curve("importers"), share)).otherwise(mean(curve("callers"), curve("importers"))),
        "difficulty": mean(curve("cyclo"), curve("cognitive")), "history": mean(curve("bug_commits"), curve("churn")), "kind": mean(curve("flags"), curve("roles"), curve("exported")),
        "safety_net": F.when(F.col("changed_funcs") > 0, F.col("untested") / F.col("changed_funcs")),
    }
    whole = F.col("degraded").isNull() if "degraded" in measures.columns else F.lit(True)
    x = measures.withColumns({name: F.when(whole, f) for name, f in factors.items()})
    total = sum((F.coalesce(name, F.lit(0.0)) for name in factors), F.lit(0.0))
    count = sum((F.when(F.col(name).isNotNull(), 1).otherwise(0) for name in factors), F.lit(0))
    return x.withColumn("score", three(F.when(count > 0, total / count))).withColumns({name: three(F.col(name)) for name in factors})


def rung(path: Column, tokens: list[str]) -> Column:
    """The last element of a decision path that is one of the tokens."""
    return F.element_at(F.filter(F.reverse(path), lambda x: x.isin(*tokens)), 1)
