"""Public-suffix rules: a small default table and a reader for the list's text format."""

from __future__ import annotations

from dataclasses import dataclass

#: A hand-written default; pass a list file for complete coverage.
_PLAIN = """com net org edu gov mil int info biz name io co me tv cc eu uk us de fr es it nl be ch at se no fi dk pl cz pt gr ie
ru ua cn jp kr in au nz za br mx ar cl ca tr il sg hk tw id my th vn ph online site xyz top shop club app dev tech store live
co.uk org.uk ac.uk gov.uk ltd.uk plc.uk me.uk net.uk com.au net.au org.au edu.au gov.au co.nz net.nz org.nz govt.nz
co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr com.br net.br org.br gov.br com.mx org.mx com.ar com.tr com.cn net.cn org.cn
co.in net.in org.in co.za org.za com.sg com.hk com.tw co.id com.my co.th com.vn com.ph com.ua com.pl co.il city.kawasaki.jp"""
_DEFAULT = [*_PLAIN.split(), "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp"]


@dataclass(frozen=True)
class SuffixRules:
    plain: frozenset[str]
    wildcard_parents: frozenset[str]
    exceptions: frozenset[str]

    @classmethod
    def of(cls, rules: list[str]) -> SuffixRules:
        """Rules with non-ASCII labels count in both their written and their ASCII form."""
        both = set(rules)
        for r in rules:
            if not r.isascii():
                mark = "*." if r.startswith("*.") else "!" if r.startswith("!") else ""
                both.add(mark + r.removeprefix(mark).encode("idna").decode("ascii"))
        plain = {r for r in both if r[0] not in "*!"}
        return cls(frozenset(plain), frozenset(r[2:] for r in both if r.startswith("*.")), frozenset(r[1:] for r in both if r[0] == "!"))


DEFAULT_RULES = SuffixRules.of(_DEFAULT)


def read_rules(path: str, *, private: bool = False) -> SuffixRules:
    """Rules of a list file; the private section is left out unless asked for."""
    rules, in_private = [], False
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if "===BEGIN PRIVATE" in line:
                in_private = True
            elif "===END PRIVATE" in line:
                in_private = False
            rule = line.split()[0] if line.strip() else ""
            if rule and not rule.startswith("//") and (private or not in_private):
                rules.append(rule.lower())
    return SuffixRules.of(rules)
