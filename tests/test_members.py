import pytest

from graphloom.sources.extract import facts, script_of
from graphloom.sources.members import member_facts, members

SOURCE = """import { Foo, bar as b } from './x'
// class Ghost { m() {} }
export class Box<T> extends Foo {
  static made = 0; private hidden = { a: 1 }
  private helper() { return '}' }
  #own = 1
  size?: number
  constructor(x) { this.size = x }
  /** Kept.
   * @public */
  async open(a = { k: 1 }) { const inner = 1; return `${limit} }` }
  get width() { return 1 }
  set width(v) {}
  static build() {}
}
export enum Color { Red = 'a,b', 'Blue', Green = f(1, 2) }
export namespace N { export const deep = { x: 1 }; function no() {} export function yes() {} }
export const limit = 3
const made = new Foo(1)
made.run(); b.value = 2; if (b.value == 2) o.Foo.all()
const o = { limit: limit }
export default class {}
"""


def test_members():
    rows = members("a.ts", SOURCE)
    got = [(r[1], r[2], r[3]) for r in rows if r[0] == "member"]
    assert got == [
        ("Box", "made", "StaticProperty"), ("Box", "helper", "Method"), ("Box", "size", "Property"), ("Box", "open", "Method"), ("Box", "width", "Getter"),
        ("Box", "width", "Setter"), ("Box", "build", "StaticMethod"), ("Color", "Red", "EnumVariant"), ("Color", "Blue", "EnumVariant"), ("Color", "Green", "EnumVariant"),
        ("N", "deep", "NamespaceMember"), ("N", "yes", "NamespaceMember"),
    ]
    assert [(r[2], r[5]) for r in rows if r[4]] == [("open", 11)]


def test_accesses_and_uses():
    rows = members("a.ts", SOURCE)
    assert [r[:3] for r in rows if r[0] in ("read", "write")] == [("read", "Foo", "run"), ("write", "b", "value"), ("read", "b", "value"), ("read", "Foo", "all")]
    assert [(r[2], r[5]) for r in rows if r[0] == "use"] == [("limit", 11), ("limit", 21)]


@pytest.mark.parametrize("text", ["", "export class", "export class A {", "export enum E {}", "`", "export namespace N { export const"])
def test_broken(text):
    assert members("a.ts", text) is not None


def test_component_lines():
    text = "<template><Big/></template>\n<script>\nimport Big from './b.vue'\n</script>\n<script setup>\nimport { z } from 'z'\n</script>\n"
    assert script_of("a.vue", text)[0].split("\n")[2] == "import Big from './b.vue'"
    assert [(f[1], f[5]) for f in facts("a.vue", text) if f[0] == "import"] == [("./b.vue", 3), ("z", 6)]
    assert [(f[2], f[5]) for f in facts("a.vue", text) if f[0] == "component"] == [("Big", 1)]


def test_frame(spark):
    df = spark.createDataFrame([("a.ts", SOURCE), (None, None), ("b.ts", "")], "rel_path string, text string")
    assert member_facts(df).where("rel_path = 'a.ts' and kind = 'member'").count() == 12
