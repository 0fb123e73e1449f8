"""A front end for Rust sources: a lossless tokenizer and a structural reader that turn one file's text into fact rows.

Items are read by their structure; expressions by patterns over tokens, which needs no full grammar and never fails on
unknown syntax. A file whose brackets don't match gives one `bad` row instead of facts. Everything here is plain Python on one file at a time; see
code.py for its use on executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<doc>///(?!/)[^\n]*|//![^\n]*)|(?P<line>//[^\n]*)|(?P<block>/\*)
    |(?P<raw>b?r(?P<hash>\#*)".*?"(?P=hash))|(?P<str>b?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])')
    |(?P<life>'[A-Za-z_]\w*)|(?P<num>\d[\w]*(?:\.\d[\w]*)?(?:[eE][+-]?\d+)?)|(?P<id>(?:r\#)?[A-Za-z_]\w*)
    |(?P<op>::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|\.\.=|\.\.\.|\.\.|<<=|>>=|[-+*/%^!&|=<>@.,;:\#$?~(){}\[\]\\])""",
    re.X | re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
ITEMS = {"fn", "struct", "enum", "trait", "impl", "mod", "type", "const", "static", "use", "macro_rules", "union"}
_KEYWORDS = set("as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while yield".split())


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int


class Unbalanced(ValueError):
    pass


def tokens(source: str) -> tuple[list[Token], list[Token]]:
    """Code tokens (doc comments among them) and plain comments."""
    out, comments, at, line = [], [], 0, 1
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            at += 1
            continue
        kind, text = m.lastgroup, m[0]
        kind = "raw" if kind == "hash" else kind
        if kind == "block":
            depth, end = 1, at + 2
            while depth and end < len(source):
                two = source[end : end + 2]
                depth += (two == "/*") - (two == "*/")
                end += 2 if two in ("/*", "*/") else 1
            text = source[at:end]
            (out if text.startswith("/**") and text != "/**/" else comments).append(Token("doc" if text.startswith("/**") else "comment", text, line))
        elif kind == "line":
            comments.append(Token("comment", text, line))
        elif kind != "space":
            out.append(Token({"raw": "str"}.get(kind, kind), text, line))
        line += text.count("\n")
        at += len(text)
    return out, comments


def module_of(path: str) -> str:
    """Module name from a path below the root: without the first `src`, the ending, and a last main, lib or mod."""
    parts = path.removesuffix(".rs").split("/")
    if "src" in parts:
        parts.remove("src")
    if parts and parts[-1] in ("main", "lib", "mod"):
        parts.pop()
    return "::".join(parts)


def scope_reason(path: str) -> str | None:
    """Why a file is test code, or None: a folder `tests` or `benches`, or a name like a test's."""
    parts = path.removesuffix(".rs").split("/")
    if {"tests", "benches"} & set(parts[:-1]):
        return "folder"
    return "name" if parts[-1] == "tests" or parts[-1].endswith(("_test", "_tests")) else None


def _text(toks: list[Token]) -> str:
    """Tokens as canonical text: blanks only between words and after commas."""
    out = ""
    for t in toks:
        if t.kind == "doc":
            continue
        if out and (out[-1].isalnum() or out[-1] == "_") and (t.text[0].isalnum() or t.text[0] in "_'"):
            out += " "
        out += t.text + (" " if t.text in (",", "->") else "")
        if t.text == "->":
            out = out[:-3] + " -> " if not out[:-3].endswith(" ") else out
    return out.strip()


def _split(toks: list[Token], at: str = ",") -> list[list[Token]]:
    """Cut at a sign outside brackets and, for types, angle brackets."""
    out, depth, angle, now = [], 0, 0, []
    for t in toks:
        depth += (t.text in _OPEN and t.kind == "op") - (t.text in _CLOSE and t.kind == "op")
        if t.kind == "op" and not depth:
            angle += (t.text == "<") - (t.text == ">")
        if t.kind == "op" and t.text == at and depth == 0 and angle <= 0:
            out.append(now)
            now = []
        else:
            now.append(t)
    return [x for x in [*out, now] if x]


class Reader:
    """Facts of one file, as lists of rows by table."""

    def __init__(self, path: str, source: str):
        self.path, self.module = path, module_of(path)
        self.toks, self.comments = tokens(source)
        self.match: dict[int, int] = {}
        stack = []
        for i, t in enumerate(self.toks):
            if t.kind == "op" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in _CLOSE:
                if not stack or _OPEN[self.toks[stack[-1]].text] != t.text:
                    raise Unbalanced(f"line {t.line}")
                self.match[stack.pop()] = i
        if stack:
            raise Unbalanced(f"line {self.toks[stack[-1]].line}")
        self.rows: dict[str, list[dict]] = {}
        self.items(0, len(self.toks), [], None, None, 0, False)
        self.waivers()

    def put(self, table: str, **row) -> None:
        self.rows.setdefault(table, []).append({"file": self.path, **row})

    def sign(self, i: int, text: str) -> bool:
        return i < len(self.toks) and self.toks[i].text == text and self.toks[i].kind in ("op", "id")

    def angle_end(self, i: int) -> int:
        """The place after the generics that open at i."""
        depth = 0
        while i < len(self.toks):
            t = self.toks[i]
            if t.kind == "op":
                depth += t.text.count("<") * (t.text in ("<", "<<")) - t.text.count(">") * (t.text in (">", ">>", ">>=", ">="))
                if t.text in _OPEN:
                    i = self.match[i]
            i += 1
            if depth <= 0:
                return i
        return i

    def items(self, i: int, end: int, inner: list[str], owner: str | None, trait: str | None, depth: int, test: bool) -> None:
        while i < end:
            start, docs, attrs = i, [], []
            while i < end and (self.toks[i].kind == "doc" or self.sign(i, "#")):
                if self.toks[i].kind == "doc":
                    docs.append(self.toks[i])
                    i += 1
                else:
                    i += 1 + self.sign(i + 1, "!")
                    if self.sign(i, "["):
                        attrs.append(_text(self.toks[i + 1 : self.match[i]]))
                        i = self.match[i] + 1
            head, vis = i, "priv"
            if self.sign(i, "pub"):
                vis, i = "pub", i + 1
                if self.sign(i, "("):
                    vis, i = f"pub({_text(self.toks[i + 1 : self.match[i]])})", self.match[i] + 1
            while i < end and self.toks[i].text in ("unsafe", "async", "default", "extern") or (i < end and self.toks[i].kind == "str") or (self.sign(i, "const") and i + 1 < end and self.toks[i + 1].text in ("fn", "unsafe", "async")):
                i += 1
            if i >= end:
                break
            word = self.toks[i].text
            if self.toks[i].kind != "id" or word not in ITEMS:
                # not an item: a macro call or a stray token
                i = self.match[i] + 1 if i in self.match else i + 1
                continue
            is_test = test or any(a == "test" or a.endswith("::test") or a.replace(" ", "") == "cfg(test)" for a in attrs)
            i = self.item(word, i, end, head, docs, attrs, vis, inner, owner, trait, depth, is_test, start)

    def finish(self, i: int, end: int) -> int:
        """The place after an item: its closing brace or semicolon."""
        while i < end:
            if self.sign(i, ";"):
                return i + 1
            if i in self.match:
                i = self.match[i]
                if self.toks[i].text == "}":
                    return i + 1
            i += 1
        return i

    def item(self, word, i, end, head, docs, attrs, vis, inner, owner, trait, depth, test, start) -> int:
        last = self.finish(i, end)
        name_at = i + 2 if word == "macro_rules" else i + 1
        name = self.toks[name_at].text if name_at < len(self.toks) and self.toks[name_at].kind == "id" else ""
        kind, stop = word, self.toks[min(last, len(self.toks)) - 1].line
        qualified = "::".join(x for x in [self.module, *inner, *([owner or trait] if owner or trait else [])] if x)
        row = {"kind": kind, "name": name, "line": self.toks[head].line, "doc_start": self.toks[start].line, "end": stop, "doc": "\n".join(d.text.lstrip("/!* ").rstrip("*/ ") for d in docs) or None, "depth": depth, "vis": vis, "module": self.module, "owner": owner, "trait_name": trait, "allow_dead": any("dead_code" in a for a in attrs), "is_test": test, "attrs": attrs, "sig": None, "params": [], "ret": "", "fields": [], "variants": []}
        body = next((k for k in range(i, last) if self.sign(k, "{")), None) if word in ("fn", "struct", "enum", "trait", "impl", "mod", "union") else None
        if body is not None and any(self.sign(k, ";") for k in range(i, body) if not any(a < k < b for a, b in self.match.items() if i <= a < body)):
            body = None
        if word == "use":
            self.uses(self.toks[i + 1 : last - 1], [])
            return last
        if word == "fn":
            k = name_at + 1
            k = self.angle_end(k) if self.sign(k, "<") else k
            if self.sign(k, "("):
                row["params"] = [_text([t for t in p if t.text != "#"]) for p in _split(self.toks[k + 1 : self.match[k]])]
                r = self.match[k] + 1
                upto = body if body is not None else last - 1
                ret = self.toks[r:upto]
                where = next((n for n, t in enumerate(ret) if t.text == "where"), len(ret))
                row["ret"] = _text(ret[1:where]) if ret and ret[0].text == "->" else ""
                row["sig"] = f"fn {name}({', '.join(row['params'])})" + (f" -> {row['ret']}" if row["ret"] else "")
        elif word in ("struct", "union"):
            k = name_at + 1
            k = self.angle_end(k) if self.sign(k, "<") else k
            if body is not None:
                row["fields"] = self.fields(body)
            elif self.sign(k, "("):
                row["fields"] = [{"name": str(n), "type": _text([t for t in p if t.text != "pub"]), "vis": "pub" if any(t.text == "pub" for t in p) else "priv", "line": p[0].line} for n, p in enumerate(_split(self.toks[k + 1 : self.match[k]]))]
        elif word == "enum" and body is not None:
            row["variants"] = [next((t.text for n, t in enumerate(p) if t.kind == "id" and not (n and p[n - 1].text == "[")), "") for p in map(self.bare, _split(self.toks[body + 1 : self.match[body]])) if p]
        if word == "impl" and body is not None:
            k = self.angle_end(i + 1) if self.sign(i + 1, "<") else i + 1
            header = self.toks[k:body]
            where = next((n for n, t in enumerate(header) if t.text == "where"), len(header))
            header = header[:where]
            split = next((n for n, t in enumerate(header) if t.text == "for" and t.kind == "id"), None)
            target, of = (header[split + 1 :], _text(header[:split])) if split is not None else (header, None)
            target = _text(target)
            bare = re.sub(r"<.*", "", target).split("::")[-1].lstrip("&").strip()
            row |= {"name": bare, "trait_name": of, "sig": target}
            self.put("defns", qpath="::".join(x for x in [qualified, bare] if x), **row)
            self.items(body + 1, self.match[body], inner, bare, of, depth + 1, test)
            return last
        self.put("defns", qpath="::".join(x for x in [qualified, name] if x), **row)
        if body is not None:
            if word == "mod":
                self.items(body + 1, self.match[body], [*inner, name], None, None, depth + 1, test)
            elif word == "trait":
                self.items(body + 1, self.match[body], inner, None, name, depth + 1, test)
            elif word == "fn":
                Body(self, qualified + "::" + name if qualified else name, owner, body + 1, self.match[body], row, trait is not None and owner is not None)
        return last

    @staticmethod
    def bare(p: list[Token]) -> list[Token]:
        """Without leading docs and attributes."""
        while p and (p[0].kind == "doc" or p[0].text == "#"):
            if p[0].kind == "doc":
                p = p[1:]
            else:
                depth = 0
                for n, t in enumerate(p):
                    depth += (t.text == "[") - (t.text == "]")
                    if n and not depth:
                        p = p[n + 1 :]
                        break
        return p

    def fields(self, body: int) -> list[dict]:
        out = []
        for p in map(self.bare, _split(self.toks[body + 1 : self.match[body]])):
            colon = next((n for n, t in enumerate(p) if t.text == ":"), None)
            if colon:
                out.append({"name": p[colon - 1].text, "type": _text(p[colon + 1 :]), "vis": "pub" if p[0].text == "pub" else "priv", "line": p[0].line})
        return out

    def uses(self, toks: list[Token], prefix: list[str]) -> None:
        for part in _split(toks):
            path, n = list(prefix), 0
            while n < len(part) and part[n].text != "{" and part[n].text != "as":
                if part[n].text == "*":
                    self.put("uses", line=part[n].line, alias=None, path="::".join(path), glob=True)
                elif part[n].kind == "id":
                    path.append(part[n].text)
                n += 1
            if n < len(part) and part[n].text == "{":
                self.uses(part[n + 1 : -1], path)
            elif part[-1].text != "*" and path:
                full = path[:-1] if path[-1] == "self" else path
                self.put("uses", line=part[0].line, alias=part[-1].text if n < len(part) else full[-1], path="::".join(full), glob=False)

    def waivers(self) -> None:
        for t in self.comments:
            m = re.match(r"//\s*(?:lint|audit)\s*:\s*(?:ok|ignore|allow)\s*(?:\(([^/()]+)(?:/([^()]+))?\))?\s*(\d{4}-\d{2}-\d{2})?\s*(?:[-–—]+\s*(.*))?$", t.text)
            if m:
                same = any(x.line == t.line for x in self.toks)
                after = next((x.line for x in self.toks if x.line > t.line), t.line)
                lo = hi = t.line if same else after
                for d in self.rows.get("defns", []):
                    if not same and d["doc_start"] <= after <= d["line"]:
                        lo, hi = d["line"], d["end"]
                self.put("waivers", comment_line=t.line, lo=lo, hi=hi, check=m[1], key=m[2], date=m[3], reason=m[4], trailing=same)


_CONVERT = {"into", "try_into", "to_string", "to_owned", "as_str", "as_bytes", "to_vec", "into_iter", "as_ref", "as_mut", "parse", "to_lowercase", "to_uppercase"}
_SWALLOW = {"ok": ".ok", "err": ".err", "unwrap_or": "unwrap_or", "unwrap_or_default": "unwrap_or_default", "unwrap_or_else": "unwrap_or_else", "map_err": "map_err"}
_PANIC = {"unwrap": "unwrap", "expect": "expect", "panic": "panic", "unreachable": "unreachable", "todo": "todo", "unimplemented": "unimplemented"}
_ASSERT = {"assert", "assert_eq", "assert_ne", "debug_assert", "debug_assert_eq", "debug_assert_ne", "ensure"}
_WIDTH = {f"{s}{b}": (s, b) for s in "iu" for b in (8, 16, 32, 64, 128)} | {"usize": ("u", 64), "isize": ("i", 64)}


def cast_class(src: str | None, dst: str) -> str:
    """Class of a numeric cast: from an unknown source by its target alone."""
    if dst.startswith("*"):
        return "ptr"
    if dst in ("f32", "f64"):
        return "to-float" if src in _WIDTH else "float" if src in ("f32", "f64") else "unknown-to-float"
    if dst not in _WIDTH:
        return "other"
    if src in ("f32", "f64"):
        return "float-to-int"
    if src not in _WIDTH:
        return "bool-to-int" if src == "bool" else "char-to-int" if src == "char" else "unknown-to-int"
    (s, a), (d, b) = _WIDTH[src], _WIDTH[dst]
    if b < a:
        return "truncate"
    if s != d:
        return "sign-change" if b == a or s == "i" else "widen"
    return ("usize-widen" if dst in ("usize", "isize") else "widen") if b > a else "same"


class Body:
    """Sites in one function body, by patterns over its tokens."""

    def __init__(self, r: Reader, qpath: str, owner: str | None, a: int, b: int, row: dict, in_trait_impl: bool):
        self.r, self.q, self.owner = r, qpath, owner
        toks = r.toks
        cyclo, nest, deepest = 1, [], 0
        types = {}
        for p in row["params"]:
            m = re.match(r"(?:mut )?(\w+):\s*&?(?:mut )?(\w+)$", p)
            if m:
                types[m[1]] = m[2]
        bound = {w for p in row["params"] for w in re.findall(r"\b[a-z_]\w*", p.split(":")[0])}
        skeleton, leaves, names = [], [], {}
        for i in range(a, b):
            t, nxt, prev = toks[i], toks[i + 1] if i + 1 < len(toks) else toks[i], toks[i - 1]
            text = t.text
            # canonical body
            if t.kind == "id" and text not in _KEYWORDS:
                called = nxt.text in ("(", "!", "::") or prev.text in (".", "::")
                skeleton.append("I" if called else f"v{names.setdefault(text, len(names))}")
                leaves.extend([text] if called else [])
            elif t.kind in ("str", "num", "char"):
                skeleton.append("L")
                leaves.append(text)
            elif t.kind != "doc":
                skeleton.append(text)
            if t.kind == "op":
                if text == "{":
                    head = self.head(i, a)
                    if head in ("if", "match", "while", "for", "loop", "else"):
                        nest.append(r.match[i])
                        deepest = max(deepest, len(nest))
                while nest and i >= nest[-1]:
                    nest.pop()
                if text in ("&&", "||", "?") and not (text == "||" and prev.text in ("(", ",", "=", "move")):
                    cyclo += 1
                raw = text in ("+", "-", "*", "/", "<<", "+=", "-=", "*=", "/=", "<<=", ">>=") and (prev.kind in ("id", "num") and prev.text not in _KEYWORDS or prev.text in (")", "]"))
                if raw and not (nxt.kind == "str" or prev.kind == "str") and not (text in ("*", "-") and nxt.text in (",", ")")):
                    r.put("arith_sites", line=t.line, scope=qpath, op={"+": "add", "-": "sub", "*": "mul", "/": "div", "<<": "shl", ">>": "shr"}[text.removesuffix("=")], checked=False, spelling=text)
                if text in ("==", "!="):
                    for side in (prev, nxt):
                        if side.kind == "str":
                            self.site("stringly", "cmp-eq", t.line, side.text[:32])
                continue
            if t.kind != "id":
                continue
            if text in ("if", "while", "for", "loop"):
                cyclo += 1
            if text == "let":
                k = i + 1 + r.sign(i + 1, "mut")
                if toks[k].kind == "id":
                    bound.add(toks[k].text)
                    if toks[k].text == "_" and r.sign(k + 1, "="):
                        self.site("swallow", "let-_", t.line, "")
                    suffix = re.search(r"[iuf](?:8|16|32|64|128|size)$", toks[k + 2].text) if r.sign(k + 1, "=") and toks[k + 2].kind == "num" else None
                    if suffix:
                        types[toks[k].text] = suffix[0]
                    m = _text(toks[k : k + 4])
                    m = re.match(r"(\w+):(\w+)", m)
                    if m:
                        types[m[1]] = m[2]
            if text == "as" and prev.text not in ("use",):
                k = i + 1
                while k < b and (toks[k].kind in ("id", "life") or toks[k].text in ("::", "*", "&")):
                    k += 1
                dst = _text(toks[i + 1 : k])
                src = types.get(prev.text) if prev.kind == "id" else next((s for s in _WIDTH if prev.text.endswith(s)), None) if prev.kind == "num" else "usize" if prev.text == ")" and toks[i - 3].text in ("len", "count") else None
                r.put("casts", line=t.line, in_fn=qpath, src=src, dst=dst, cls=cast_class(src, dst))
            if text == "match":
                cyclo += self.match_arms(i, b)
            if text in ("return",) and toks[i + 1].text in ("Err", "None"):
                self.site("assert", "guard-return-err" if toks[i + 1].text == "Err" else "guard-return-none", t.line, "")
            if nxt.text == "!" and r.sign(i + 2, "(") | r.sign(i + 2, "[") | r.sign(i + 2, "{"):
                self.call(i, text + "!", False)
                if text in _PANIC:
                    self.site("panic", _PANIC[text], t.line, _text(toks[i + 3 : r.match[i + 2]])[:80])
                if text in _ASSERT:
                    self.site("assert", "debug-assert" if text.startswith("debug") else text, t.line, "")
                if text == "bail":
                    self.site("assert", "guard-bail", t.line, "")
                continue
            k = i + 1
            if r.sign(k, "::") and r.sign(k + 1, "<"):
                k = r.angle_end(k + 1)
            if r.sign(k, "(") and text not in _KEYWORDS | {"fn"}:
                if prev.text == ".":
                    self.call(i, "." + text, toks[i - 2].text == "self")
                    root = toks[i - 2].text if toks[i - 2].kind == "id" else ""
                    if text in _PANIC:
                        self.site("panic", _PANIC[text], t.line, self.receiver(i, a))
                    if text in _SWALLOW:
                        self.site("swallow", _SWALLOW[text], t.line, self.receiver(i, a))
                    if text in _CONVERT:
                        self.site("conversion", text, t.line, root)
                    if text in ("eq", "ne", "starts_with", "ends_with", "contains") and toks[k + 1].kind == "str":
                        self.site("stringly", "cmp-method" if text in ("eq", "ne") else "substr", t.line, toks[k + 1].text[:32])
                    m = re.match(r"(saturating|checked|wrapping|overflowing)_(add|sub|mul|div|shl|shr)$", text)
                    if m:
                        r.put("arith_sites", line=t.line, scope=qpath, op=m[2], checked=True, spelling=text)
                elif prev.text != "fn":
                    path, j = [text], i
                    while r.sign(j - 1, "::") and toks[j - 2].kind == "id":
                        path.insert(0, toks[j - 2].text)
                        j -= 2
                    target = "::".join(path)
                    self.call(i, target, path[0] in ("self", "Self"), len(path) == 1 and text in bound)
                    if text in ("from", "try_from") and len(path) > 1:
                        self.site("conversion", f"::{text}", t.line, path[-2])
                    if len(path) > 1:
                        self.chain(j, k, target)
                    for arg in _split(toks[k + 1 : r.match[k]]):
                        if all(x.kind == "id" or x.text == "::" for x in arg) and arg[-1].text[:1].islower() and arg[-1].text not in _KEYWORDS and (len(arg) > 1 or arg[0].text not in bound):
                            r.put("call_sites", line=arg[0].line, caller=qpath, target=_text(arg), shadowed=False, receiver_is_self=False, as_value=True)
            elif prev.text == "." and t.kind == "id" and text != "await":
                write = r.sign(i + 1, "=") or (nxt.text.endswith("=") and nxt.text[:1] in "+-*/%^&|" and len(nxt.text) == 2)
                r.put("field_refs", line=t.line, in_fn=qpath, field=text, receiver=toks[i - 2].text, kind="write" if write else "read", via="self" if toks[i - 2].text == "self" else "ti" if toks[i - 2].text in types else "?", type=owner if toks[i - 2].text == "self" else types.get(toks[i - 2].text))
            elif text[:1].isupper() and nxt.text == "{" and self.head(i + 1, a) not in ("match", "if", "while", "for") and prev.text not in ("impl", "struct", "enum", "trait", "for"):
                self.literal(i + 1, owner if text == "Self" and owner else text)
            if text[:1].isupper() and prev.text != "::":
                r.put("type_refs", line=t.line, in_fn=qpath, type=text, role="path" if nxt.text == "::" else "use")
        size, digest = len(skeleton), " ".join(skeleton)
        statements = [s for s in self.statements(a, b) if s]
        r.put("bodies", name=row["name"], qpath=qpath, line=row["line"], end=row["end"], tokens=size, skeleton=digest, leaves=leaves, in_trait_impl=in_trait_impl, cyclo=cyclo, nesting=deepest, params=len(row["params"]), statements=len(statements), forwards=self.forward(statements), idents=sorted({t.text for t in toks[a:b] if t.kind == "id"}))

    def site(self, family: str, kind: str, line: int, detail: str) -> None:
        self.r.put("sites", family=family, kind=kind, line=line, in_fn=self.q, detail=detail)

    def call(self, i: int, target: str, to_self: bool, shadowed: bool = False) -> None:
        self.r.put("call_sites", line=self.r.toks[i].line, caller=self.q, target=target, shadowed=shadowed, receiver_is_self=to_self, as_value=False)

    def head(self, brace: int, a: int) -> str:
        """The keyword that a brace belongs to: the nearest before it in its statement."""
        i = brace - 1
        while i >= a:
            t = self.r.toks[i]
            if t.text in (")", "]", "}") and t.kind == "op":
                i = next((k for k, v in self.r.match.items() if v == i), a)
                if t.text == "}":
                    return ""
            elif t.text in (";", "{", "=>", ",", "(", "[") and t.kind == "op":
                return ""
            elif t.text in ("if", "match", "while", "for", "loop", "else", "unsafe", "=", "return", "let"):
                return t.text
            i -= 1
        return ""

    def receiver(self, i: int, a: int) -> str:
        k = i
        while k > a and self.r.toks[k - 1].text not in (";", "{", "}", "=", "=>", ",", "return"):
            k -= 1
        return _text(self.r.toks[k : i - 1])[:80]

    def match_arms(self, i: int, b: int) -> int:
        """A dispatch site if an arm names an enum's variant; the number of arms that are not wildcards."""
        r, k = self.r, i + 1
        while k < b and not r.sign(k, "{"):
            k = r.match[k] + 1 if k in r.match else k + 1
        if k >= b:
            return 0
        end, k, arms, variants, wildcard = r.match[k], k + 1, 0, {}, False
        while k < end:
            start = k
            while k < end and not r.sign(k, "=>"):
                k = r.match[k] + 1 if k in r.match else k + 1
            pattern = r.toks[start:k]
            guard = next((n for n, t in enumerate(pattern) if t.text == "if"), len(pattern))
            plain = False
            for alt in _split(pattern[:guard], "|"):
                alt = self.r.bare(alt)
                if len(alt) == 1 and alt[0].kind == "id" and alt[0].text[:1] in "_abcdefghijklmnopqrstuvwxyz" and alt[0].text not in ("true", "false"):
                    plain = True
                for n in range(len(alt) - 2):
                    if alt[n].kind == "id" and alt[n + 1].text == "::" and alt[n + 2].kind == "id" and not (n + 3 < len(alt) and alt[n + 3].text == "::") and alt[n + 2].text[:1].isupper():
                        variants.setdefault(self.owner if alt[n].text == "Self" and self.owner else alt[n].text, set()).add(alt[n + 2].text)
                if len(alt) == 1 and alt[0].kind == "str":
                    self.site("stringly", "match-lit", alt[0].line, alt[0].text[:32])
            wildcard |= plain
            arms += not plain
            k += 1
            if k < end and r.sign(k, "{"):
                k = r.match[k] + 1
            else:
                while k < end and not r.sign(k, ","):
                    k = r.match[k] + 1 if k in r.match else k + 1
            k += r.sign(k, ",")
        for enum, names in variants.items():
            r.put("dispatch_sites", enum=enum, line=r.toks[i].line, context=self.q, variants=sorted(names), wildcard=wildcard)
        return arms

    def literal(self, brace: int, name: str) -> None:
        r = self.r
        fields, computed, rest = {}, [], False
        for p in _split(r.toks[brace + 1 : r.match[brace]]):
            if p[0].text == "..":
                rest = True
            elif len(p) > 2 and p[1].text == ":" and p[0].kind == "id":
                value = p[2:]
                constant = all(t.kind in ("str", "num", "char") or t.text in ("true", "false", "-", "::", "&", "None") or (t.kind == "id" and t.text[:1].isupper()) for t in value)
                (fields.__setitem__(p[0].text, _text(value)) if constant else computed.append(p[0].text))
            elif len(p) == 1 and p[0].kind == "id":
                computed.append(p[0].text)
            else:
                return
        if fields and name != self.owner:
            r.put("literals", line=r.toks[brace].line, type=name, context=self.q, fields=fields, computed=computed, has_rest=rest)

    def chain(self, start: int, paren: int, root: str) -> None:
        r, k, methods = self.r, self.r.match[paren] + 1, []
        while r.sign(k, "?") or (r.sign(k, ".") and r.toks[k + 1].kind == "id"):
            if r.sign(k, "?"):
                k += 1
                continue
            name, k = r.toks[k + 1].text, k + 2
            if r.sign(k, "::"):
                k = r.angle_end(k + 1)
            if not r.sign(k, "("):
                break
            methods.append(name)
            k = r.match[k] + 1
        args = r.toks[paren + 1 : r.match[paren]]
        if methods:
            constant = all(t.kind in ("str", "num", "char") or t.text == "," for t in args)
            r.put("chains", line=r.toks[start].line, root=root, root_args=_text(args) if constant else "", methods=sorted(set(methods)), context=self.q)

    def statements(self, a: int, b: int) -> list[list[Token]]:
        return _split(self.r.toks[a:b], ";")

    @staticmethod
    def forward(statements: list[list[Token]]) -> str | None:
        """The callee, if the body is one call."""
        if len(statements) != 1:
            return None
        m = re.match(r"(?:return )?((?:self\.)?(?:\w+(?:::|\.))*\w+!?)\(.*\)$", _text(statements[0]), re.S)
        return m[1] if m and not re.search(r"\b(if|match|for|while)\b", _text(statements[0])) else None


def facts(path: str, source: str) -> dict[str, list[dict]]:
    """Tables of one file; a table `bad` with the reason where it can't be read."""
    try:
        return Reader(path, source).rows
    except (Unbalanced, RecursionError) as e:
        return {"bad": [{"file": path, "reason": str(e)}]}
