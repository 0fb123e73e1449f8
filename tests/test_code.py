"""The Rust front end and the questions about a tree, on sources of our own."""

import pytest

from lodestone.plans import code_queries as q
from lodestone.sources import rust
from lodestone.sources.code import Facts, read_files

LIB = '''
//! Top.
use crate::util::{helper, deep::Thing as Alias, self};
use std::fmt::*;

/// Adds two.
///
/// # Panics
/// never, see `helper` and `vanished`
pub fn add(a: i32, b: usize) -> Result<i32, String> {
    let n = 3u8;
    let wide = n as u32;
    let cut = b as u16;
    if wide > 3 && b == 2 { return Err("no".to_string()); }
    for i in 0..3 { if i > 1 { helper(i); } }
    Ok(a.saturating_add(1).saturating_add(2) + a)
}

pub enum Kind { Red, Green(u8), Blue { x: i32 } }
pub enum Other { One, Two }

fn full(k: Kind) -> u8 { match k { Kind::Red => 1, Kind::Green(_) | Kind::Blue { .. } => 2 } }
fn part(k: Kind) -> u8 { match k { Kind::Red => 1, Kind::Green(n) if n > 1 => 3, _ => 0 } }
fn twin(k: Kind) -> u8 { match k { Kind::Red => 1, _ => 7 } }

pub struct Config { pub name: &'static str, depth: u32, fast: bool }
impl Config {
    pub fn new() -> Self { Self { name: "x", depth: 1, fast: true } }
    fn depth(&self) -> u32 { self.depth }
    fn grow(&mut self) { self.depth += 1; self.fast = false; }
}
fn one() -> Config { Config { name: "a", depth: 1, fast: true } }
fn two() -> Config { Config { name: "b", depth: 2, fast: true } }

struct UserId(u64);
struct OrderId(u64);

impl From<UserId> for OrderId { fn from(u: UserId) -> Self { OrderId(u.0) } }
impl From<OrderId> for UserId { fn from(o: OrderId) -> Self { UserId(o.0) } }

fn shout(m: &mut Config) { m.grow() }
fn forward(x: u8) -> u8 { other::call(x) }
fn swallow() { let _ = std::fs::write("a", "b"); let v = "5".parse::<u8>().unwrap_or(0); v.into(); }
fn boom(s: &str) { s.parse::<u8>().unwrap(); todo!() }
fn build() { Builder::new("a").size(1).color(2).done(); }
fn build_lean() { Builder::new("a").size(1).done(); }
fn check_user(id: u8) { assert!(id > 0); }
fn check_order(id: u8) { let x = id; }
fn compare(s: &str) -> bool { s == "left" || s.eq("right") }
#[allow(dead_code)] fn kept() {}
fn lonely() { only_here(); }
fn only_here() {}

fn copied_one(items: Vec<u8>) -> u8 { let mut total = 0; for item in items { if item > 3 { total = total + item; } else { total = total - 1; } } total }
fn copied_two(values: Vec<u8>) -> u8 { let mut sum = 0; for value in values { if value > 3 { sum = sum + value; } else { sum = sum - 1; } } sum }
fn copied_near(values: Vec<u8>) -> u8 { let mut sum = 0; for value in values { if value > 4 { sum = sum + value; } else { sum = sum - 1; } } sum }

// audit: ok(panics/boom) 2025-01-02 - known
fn waived() { boom("x"); }

#[cfg(test)]
mod tests {
    use super::*;
    #[test]
    fn adds() { assert_eq!(add(1, 2).unwrap(), 2); let r = r#"raw " fn nothing() {"#; let c = '\\''; let l: &'static str = "y"; }
}
'''
UTIL = "pub fn helper(x: i32) -> i32 { lonely_not(x) }\n/* a /* nested */ comment */\npub mod deep { pub struct Thing; }\n"


@pytest.fixture(scope="module")
def f(spark):
    return Facts.of(spark, {"src/lib.rs": LIB, "src/util.rs": UTIL, "src/broken.rs": "fn x() { (", "src/empty.rs": ""})


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_tokens_lose_nothing():
    toks, comments = rust.tokens(LIB)
    assert not [t for t in toks if t.text == "nothing"] and any(t.kind == "life" for t in toks)
    kept = "".join(t.text for t in toks) + "".join(c.text for c in comments)
    assert len("".join(kept.split())) == len("".join(LIB.split()))


def test_modules_and_scope():
    assert [rust.module_of(p) for p in ("src/lib.rs", "src/a/mod.rs", "x/src/b/c.rs", "src/main.rs")] == ["", "a", "x::b::c", ""]
    assert [rust.scope_reason(p) for p in ("tests/a.rs", "src/a_test.rs", "src/tests.rs", "src/a.rs", "benches/x.rs")] == ["folder", "name", "name", None, "folder"]


def test_inventory_and_places(f):
    kinds = {(r.kind, r.qpath) for r in q.inventory(f).collect()}
    assert {("fn", "add"), ("enum", "Kind"), ("struct", "Config"), ("fn", "Config::new"), ("impl", "Config"), ("mod", "tests"), ("fn", "tests::adds"), ("fn", "util::helper"), ("struct", "util::deep::Thing")} <= kinds
    assert rows(q.inventory(f, kind="fn", name="copied*"), "qpath") == [("copied_near",), ("copied_one",), ("copied_two",)]
    assert rows(q.outline(f, "util.rs"), "name") == [("Thing",), ("deep",), ("helper",)]
    line = next(n for n, t in enumerate(LIB.split("\n"), 1) if "self.depth += 1" in t)
    assert [r.name for r in q.at(f, "lib.rs", line).collect()] == ["Config", "grow"]
    assert "self.depth" in q.show(f, ["Config::depth"]).collect()[0].text
    assert rows(q.blind_spots(f), "file") == [("src/broken.rs",)]


def test_calls(f):
    assert rows(q.callers(f, "helper"), "caller", "confidence") == [("add", "resolved")]
    assert rows(q.callers(f, "util::helper", "resolved"), "caller") == [("add",)]
    assert rows(q.callees(f, "lonely"), "target") == [("only_here",)]
    assert ("waived", 1) in rows(q.callers_transitive(f, "boom"), "node", "depth")
    assert rows(q.callers_among(f, "boom", "wai*"), "caller") == [("waived",)]
    found = {r.line for r in q.oracle_calls(f, "helper").collect()}
    assert found and found <= {int(r.at.split(":")[1]) for r in q.callers(f, "helper").collect()}


def test_types_and_fields(f):
    assert rows(q.fields(f, "Config"), "field", "reads", "writes", "inits") == [("depth", 1, 1, 2), ("fast", 0, 1, 2), ("name", 0, 0, 2)]
    assert rows(q.takes_mut(f), "type", "mut_fns") == [("Config", 1)]
    assert rows(q.conversion_pairs(f), "a", "b") == [("OrderId", "UserId")]
    assert rows(q.impls(f, trait="From"), "name") == [("OrderId",), ("UserId",)]
    assert {r.cls for r in q.casts(f).collect()} == {"widen", "truncate"}


def test_dispatch(f):
    assert rows(q.enum_coverage(f), "enum", "missing") == [("Kind", "Blue"), ("Kind", "Blue,Green")]
    assert rows(q.catch_all_arms(f), "context") == [("part",), ("twin",)]
    assert rows(q.rank_enums(f), "enum", "partial") == [("Kind", 2)]
    got = q.divergence(f).collect()
    assert [(r.has, r.missing_here) for r in got] == [("Red", "Green")]


def test_copies(f):
    assert [(r.n, r.label) for r in q.clones(f).collect()] == [(2, "copied_one/copied_two")]
    assert rows(q.near_clones(f), "diffs") == [(1,), (1,)]


def test_drift(f):
    c = q.config_drift(f, 0.0).collect()
    assert [(r.type, r.agreed, r.differs) for r in c] == [("Config", 1, "depth")]
    b = q.builder_drift(f).collect()
    assert [(r.shared, r.differs) for r in b] == [(2, "color")]
    a = q.arith_drift(f).collect()
    assert [(r.scope, r.op, r.checked, r.raw) for r in a] == [("add", "add", 2, 1)]
    v = q.validation_drift(f).collect()
    assert v == [] or v[0].key == "check_order"


def test_sites(f):
    assert {"let-_", "unwrap_or"} <= {r.kind for r in q.error_swallows(f).collect()}
    assert {("boom", "todo"), ("boom", "unwrap")} <= set(rows(q.panics(f), "in_fn", "kind"))
    assert {r.kind for r in q.sites(f, "stringly").collect()} == {"cmp-eq", "cmp-method"}
    assert rows(q.pass_through(f), "qpath", "forwards_to").count(("forward", "other::call")) == 1
    assert rows(q.tests(f, mentions="add"), "qpath") == [("tests::adds",)]
    assert {r.kind for r in q.doc_drift(f, names=True).collect() if r.qpath == "add"} == {"panics-doc-unbacked", "stale-name"}
    m = {r.qpath: r for r in q.metrics(f).collect()}
    assert m["add"].cyclo == 5 and m["part"].cyclo >= 3 and m["add"].nesting == 2


def test_dead_code_and_waivers(f):
    dead = {r.qpath for r in q.dead_code(f).collect()}
    assert {"lonely", "forward"} <= dead and not {"only_here", "kept", "helper", "util::helper", "boom", "add"} & dead
    assert "only_here" in {r.qpath for r in q.dead_code(f, transitive=True).collect()}
    w = f.waivers.collect()
    assert [(x.check, x.key, x.date, x.reason) for x in w] == [("panics", "boom", "2025-01-02", "known")] and w[0].lo <= w[0].hi


def test_battery(f):
    out = q.audit(f, top=3)
    assert {"clones", "panics", "arith-drift"} <= {r["check"] for r in out.collect()}
    again = q.since(out, out).where("new > 0 OR gone > 0")
    assert again.count() == 0
    with pytest.raises(ValueError, match="no such check"):
        q.audit(f, only=["nothing"])


def test_scan_from_disk_reuses_facts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / "src" / "lib.rs").write_text("pub fn a() {}\n")
    (tmp_path / "tests" / "t.rs").write_text("fn b() {}\n")
    first = Facts.scan(spark, str(tmp_path))
    assert rows(first.defns, "file", "qpath") == [("src/lib.rs", "a")]
    assert rows(read_files(spark, str(tmp_path), "tests"), "file") == [("tests/t.rs",)]
    (tmp_path / "src" / "new.rs").write_text("pub fn c() {}\n")
    second = Facts.scan(spark, str(tmp_path), stored=first.rows)
    assert rows(second.defns, "qpath") == [("a",), ("new::c",)]


def test_near_clones_of_many_bodies(spark):
    """All bodies of one skeleton are compared, however many; each pair comes once."""
    body = "fn f{k}(a: u32) -> u32 {{ let b = a + {x}; let c = b * {y}; let d = c - 7; let e = d + a; let g = e * b; g + c + d + {z} }}"
    src = "\n".join(body.format(k=k, x=1, y=2, z=100 + k) for k in range(20)) + "\n" + body.format(k=99, x=50, y=60, z=70)
    got = q.near_clones(Facts.of(spark, {"src/lib.rs": src})).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == 20 * 19 // 2 and {r.diffs for r in got} == {1}
