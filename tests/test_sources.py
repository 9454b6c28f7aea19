import os

import pytest
from pyspark.sql import datasource as ds

from orrery.sources import tree
from orrery.sources.edges import import_edges
from orrery.sources.tree import scan


def make(root, files):
    for p, body in files.items():
        os.makedirs(os.path.dirname(f"{root}/{p}") or root, exist_ok=True)
        with open(f"{root}/{p}", "w", encoding="utf-8") as f:
            f.write(body)
    return str(root)


CASES = {
    "python": (
        {
            "app/__init__.py": "from app.main import run\n", "app/main.py": "import os\nfrom . import routes\n", "app/routes.py": "from .services import x, y\n",
            "app/services.py": "from app import main\nfrom ..far import q\n", "src/pkg/__init__.py": "", "src/pkg/a.py": "from pkg import b, name\nimport pkg.b as z\n", "src/pkg/b.py": "try:\n    import pkg.a\nexcept ImportError:\n    pass\n",
            "broken.py": "import app.main\nfrom app import (routes,\n    services)\ndef f(:\n",
        },
        {
            ("app/__init__.py", "app/main.py", "from"), ("app/main.py", "app/routes.py", "from"), ("app/routes.py", "app/services.py", "from"), ("app/services.py", "app/main.py", "from"),
            ("src/pkg/a.py", "src/pkg/b.py", "from"), ("src/pkg/a.py", "src/pkg/__init__.py", "from"), ("src/pkg/a.py", "src/pkg/b.py", "import"),
            ("broken.py", "app/main.py", "import"), ("broken.py", "app/routes.py", "from"), ("broken.py", "app/services.py", "from"),
        }, set(),
    ),
    "typescript": (
        {
            "ui/clock/index.tsx": "export { tick } from '../engine/gear'\nimport moment from 'moment'\n", "ui/engine/gear.ts": "const face = require(\"../clock\")\n/* require('./spring') */\n",
            "ui/engine/spring.js": "import '../../../../gone'\nimport(`./${part}`)\n", "ui/dial.jsx": "import {\n  tick,\n} from \"./engine/gear.ts\"\nimport(\"./engine/spring\")\nexport * as all from './clock'\n",
        },
        {
            ("ui/clock/index.tsx", "ui/engine/gear.ts", "import"), ("ui/engine/gear.ts", "ui/clock/index.tsx", "require"), ("ui/dial.jsx", "ui/engine/gear.ts", "import"),
            ("ui/dial.jsx", "ui/engine/spring.js", "import"), ("ui/dial.jsx", "ui/clock/index.tsx", "import"),
        }, {"typescript"},
    ),
    "java": (
        {
            "src/main/java/org/kite/Harbor.java": "package org.kite;\nimport java.util.*;\nimport org.kite.tide.Buoy;\nimport org.kite.tide.Buoy.Flag;\nimport static org.kite.Knots.tie;\ninterface Harbor {}\n",
            "src/main/java/org/kite/Knots.java": "package org.kite;\n/* import org.kite.Harbor; */\n", "src/main/java/org/kite/tide/Buoy.java": "package org.kite.tide;\nimport org.kite.Harbor;\n", "src/test/java/org/kite/tide/DriftCheck.java": "package org.kite.tide;\nimport org.kite.Knots;\n",
        },
        {
            ("src/main/java/org/kite/Harbor.java", "src/main/java/org/kite/tide/Buoy.java", "import"), ("src/main/java/org/kite/Harbor.java", "src/main/java/org/kite/Knots.java", "static"),
            ("src/main/java/org/kite/tide/Buoy.java", "src/main/java/org/kite/Harbor.java", "import"), ("src/test/java/org/kite/tide/DriftCheck.java", "src/main/java/org/kite/Knots.java", "import"),
        }, {"java"},
    ),
    "rust": (
        {
            "mill/src/main.rs": "mod wheel;\nmod granary { pub mod sacks; }\nuse crate::wheel::Paddle;\nuse std::fs;\nfn main() {}\n", "mill/src/wheel.rs": "pub mod axle;\npub struct Paddle;\nuse self::axle::Grease;\nuse super::wheel;\n",
            "mill/src/wheel/axle.rs": "use crate::wheel::Paddle as P;\nuse super::{axle, Paddle};\n#[path = \"other.rs\"] mod other;\n",
        },
        {
            ("mill/src/main.rs", "mill/src/wheel.rs", "include"), ("mill/src/main.rs", "mill/src/wheel.rs", "import"), ("mill/src/wheel.rs", "mill/src/wheel/axle.rs", "include"),
            ("mill/src/wheel.rs", "mill/src/wheel/axle.rs", "import"), ("mill/src/wheel/axle.rs", "mill/src/wheel.rs", "import"),
        }, {"rust"},
    ),
    "csharp": (
        {
            "Start.cs": "using System.Text;\nusing static Garden.Tools.Spade;\nusing Garden.Sheds;\nusing Garden.Beds;\nusing (var water = Open()) {}\n", "Garden/Beds/Tulip.cs": "namespace Garden.Beds { using G = Garden.Paths.Gravel; }\n",
            "Garden/Paths/Gravel.cs": "using Garden.Beds;\n", "Garden/Tools/Spade.cs": "", "Garden/Sheds/East.cs": "", "Garden/Sheds/West.cs": "",
        },
        {("Start.cs", "Garden/Beds/Tulip.cs", "import"), ("Start.cs", "Garden/Tools/Spade.cs", "static"), ("Garden/Paths/Gravel.cs", "Garden/Beds/Tulip.cs", "import")}, {"csharp"},
    ),
    "c": (
        {
            "kernel/boot.cc": "#include <vector>\n#include \"trap.hpp\"\n  #  include \"../drivers/uart.h\"\n/* #include \"uart.h\" */\n", "kernel/trap.hpp": "#pragma once\n", "drivers/uart.h": "#include \"../kernel/trap\"\n",
            "drivers/pins.c": "#if 0\n#include \"uart.h\"\n#endif\n#include PINS\n",
        },
        {("kernel/boot.cc", "kernel/trap.hpp", "include"), ("kernel/boot.cc", "drivers/uart.h", "include"), ("drivers/uart.h", "kernel/trap.hpp", "include"), ("drivers/pins.c", "drivers/uart.h", "include")}, {"c"},
    ),
    "go": (
        {
            "cmd/ferry/main.go": "package main\nimport \"os\"\nimport (\n\tq \"harbour.dev/ferry/quay\" // used\n\t_ \"harbour.dev/ferry/tide/table\"\n\t. \"harbour.dev/ferry/crew\"\n)\n", "quay/berth.go": "package quay\nimport \"../cmd/ferry\"\n",
            "quay/berth_test.go": "package quay\nimport \"harbour.dev/ferry/tide/table\"\n", "tide/table/rows.go": "package table\nimport `harbour.dev/ferry/quay`\n", "crew/mate.go": "package crew\n", "crew/cook.go": "package crew\n", "os/fake.go": "",
        },
        {("cmd/ferry/main.go", "quay/berth.go", "import"), ("cmd/ferry/main.go", "tide/table/rows.go", "import"), ("quay/berth.go", "cmd/ferry/main.go", "import"), ("quay/berth_test.go", "tide/table/rows.go", "import"), ("tide/table/rows.go", "quay/berth.go", "import")}, {"go"},
    ),
    "php": (
        {
            "public/entry.php": "<?php\nuse Shop\\Cart\\Basket;\nuse Shop\\{Line as L, Tax};\nuse const Shop\\Tax\\RATE;\ninclude '../setup.php';\nrequire_once(\"parts/../foot.php\");\nrequire \"$name.php\";\n// include 'gone.php';\n", "public/foot.php": "", "setup.php": "",
            "lib/src/Shop/Cart/Basket.php": "<?php\nnamespace Shop\\Cart;\nuse Shop\\Tax;\n", "lib/src/Shop/Line.php": "", "lib/src/Shop/Tax.php": "",
        },
        {
            ("public/entry.php", "lib/src/Shop/Cart/Basket.php", "import"), ("public/entry.php", "lib/src/Shop/Line.php", "import"), ("public/entry.php", "lib/src/Shop/Tax.php", "import"), ("public/entry.php", "setup.php", "include"),
            ("public/entry.php", "public/foot.php", "include"), ("lib/src/Shop/Cart/Basket.php", "lib/src/Shop/Tax.php", "import"),
        }, {"php"},
    ),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_edges(spark, tmp_path, case):
    files, want, partial = CASES[case]
    found, parts = import_edges(scan(spark, make(tmp_path, files))[0])
    got = {(r["src"], r["dst"], r["kind"]) for r in found.collect()}
    assert got == want
    assert partial <= {r["lang"] for r in parts.collect()}


def test_scan_leaves_out_what_it_must(spark, tmp_path):
    root = make(tmp_path, {"a.py": "x = 1\r\ny = 2\n", "pkg/__init__.py": "", "_b.py": "", "node_modules/x.js": "", "image.png": "", ".env": "S=1", ".env.example": "S=", "id_rsa": "k", "token.py": "", "api_token.txt": "", "tests/test_a.py": "", "skip/me.py": "", "sub/.git/config": "", "sub/z.py": "", ".orreryignore": "# no\nskip/\n", "x.egg-info/y": ""})
    os.symlink("/etc/passwd", f"{root}/out.py")
    os.symlink(f"{root}/a.py", f"{root}/in.py")
    os.symlink(f"{root}/id_rsa", f"{root}/app.py")  # what a link leads to counts, not only its own name
    os.symlink("api_token.txt", f"{root}/notes.md")
    os.symlink(f"{root}/image.png", f"{root}/picture.py")
    files, listing = scan(spark, root)
    got = {r["path"]: r for r in files.collect()}
    assert set(got) == {"a.py", "pkg/__init__.py", "_b.py", ".env.example", "token.py", "tests/test_a.py", "in.py"}
    assert got["a.py"]["raw"] == "x = 1\ny = 2\n" and got["a.py"]["line_count"] == 3
    assert [r["path"] for r in scan(spark, root, max_files=2, include_tests=False)[0].orderBy("scan_pos").collect()] == [".env.example", "pkg/__init__.py"]
    assert "pkg/" in listing.lines and "  __init__.py" in listing.lines


def test_ignore_file_that_leads_out_of_the_tree(spark, tmp_path):
    make(tmp_path, {"elsewhere": "a.py\n", "t/a.py": "", "t/b.py": ""})
    os.symlink(f"{tmp_path}/elsewhere", f"{tmp_path}/t/.orreryignore")
    assert {r["path"] for r in scan(spark, f"{tmp_path}/t")[0].collect()} == {"a.py", "b.py"}


def test_exclusions_reach_the_listing(spark, tmp_path, monkeypatch, capsys):
    """Filters on paths are in the plan, and a directory that no row can come from is not opened."""
    root = make(tmp_path, {"a.py": "", "src/one/b.py": "", "src/vendor/deep/c.py": "", "vendor/d.py": "", "src/gen_x/e.py": "", "docs/f.md": "", "docs/in/g.md": "", "p.egg-info/h": ""})
    found = tree.listed(spark, root, ["vendor", "docs/in", "*.egg-info", "gen_*"])
    found.explain("formatted")
    pushed = next(x for x in capsys.readouterr().out.splitlines() if x.startswith("PushedFilters"))
    assert all(x in pushed for x in ("Not(StringContains(path,/vendor/))", "Not(StringStartsWith(path,docs/in/))", "Not(StringContains(path,.egg-info/))"))
    assert {r["path"] for r in found.collect()} == {"a.py", "src", "src/one", "src/one/b.py", "src/vendor", "vendor", "src/gen_x", "docs", "docs/f.md", "docs/in", "p.egg-info"}
    assert {r["path"] for r in found.where("path like 'src/one/%'").collect()} == {"src/one/b.py"}

    def opened(filters, globs="[]", width="64"):
        seen, real = [], os.scandir
        reader = tree.Lister({"path": root, "globs": globs, "width": width})
        assert not list(reader.pushFilters(filters))
        monkeypatch.setattr(os, "scandir", lambda at: seen.append(os.path.relpath(at, root)) or real(at))
        rows = sorted(r[0] for p in reader.partitions() for r in reader.read(p))
        monkeypatch.undo()
        return set(seen), rows

    for width in ("1", "2", "64"):  # with few levels opened, tasks do the walking
        seen, rows = opened([ds.Not(ds.StringContains(("path",), "/vendor/")), ds.Not(ds.StringStartsWith(("path",), "vendor/"))], '["gen_*"]', width)
        assert seen == {".", "src", "src/one", "docs", "docs/in", "p.egg-info"}
        assert rows == sorted(["a.py", "src", "src/one", "src/one/b.py", "src/vendor", "vendor", "src/gen_x", "docs", "docs/f.md", "docs/in", "docs/in/g.md", "p.egg-info", "p.egg-info/h"])
        assert opened([ds.StringStartsWith(("path",), "src/on")], width=width) == ({".", "src", "src/one"}, ["src/one", "src/one/b.py"])
        assert opened([ds.EqualTo(("path",), "docs/in/g.md")], width=width) == ({".", "docs", "docs/in"}, ["docs/in/g.md"])
        assert opened([ds.In(("path",), ("a.py", "docs/f.md"))], width=width)[1] == ["a.py", "docs/f.md"]
    assert list(tree.Lister({"path": root}).pushFilters([ds.EqualTo(("name",), "x"), ds.GreaterThan(("size",), 1)])) == [ds.EqualTo(("name",), "x"), ds.GreaterThan(("size",), 1)]


def test_what_was_left_out_by_cause_and_lines(spark, tmp_path):
    root = make(tmp_path, {"a.py": "", "b/c/d.py": "", "b/e.py": "", "b/f.py": "", "b/g.py": "", "z/1.py": "", "z/2.py": "", "z/t/x.py": "", "dist": "", "i.png": "", "id_rsa": "", "tests/test_q.py": ""})
    os.symlink("/etc/passwd", f"{root}/out.py")
    _, listing = scan(spark, root, max_files=3, include_tests=False, per_dir=2)
    assert listing.causes == {"excluded": 1, "link": 1, "binary": 1, "sensitive": 1, "test": 1, "over_limit": 5} and listing.skipped == 10
    assert listing.lines == ["b/", "  c/", "    d.py", "  e.py", "  (2 more)", "tests/", "  test_q.py", "(4 more)"]
    os.mkdir(f"{root}/empty")
    empty, listing = scan(spark, f"{root}/empty")
    assert empty.count() == 0 and listing.lines == [] and listing.skipped == 0
