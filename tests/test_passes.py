"""How often steps go over their input."""

from lectern.operators import export, graph, latex, rendering
from lectern.plans import papers


def _papers(spark, template):
    return spark.createDataFrame([(str(k), template.replace("@", str(k))) for k in range(3)], "doc_id string, text string")


def _parses(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow") + plan.count("MapInPandas")


def test_environments_parse_papers_once(spark):
    made = rendering.environment_pieces(latex.ast_nodes(_papers(spark, papers.PAPER)))
    assert _parses(made) == 1
    got = {(r["doc_id"], r["node_id"]): r["piece"] for r in made.collect()}
    assert len(got) == 15 and "<abstract_text>We study 2.</abstract_text>" in got["2", 6]
    assert got["1", 17] == '<environment_start type="figure">\n<float type="figure">\n  <caption>Cap 1</caption>\n  <label>fig:1</label>\n</float>\n</environment_end>\n'


def test_graph_ids_parse_papers_once(spark):
    made = rendering.graph_nodes(latex.ast_nodes(_papers(spark, papers.FLAT), "strict"))
    assert _parses(made) <= 1  # the walk of papers that need it
    assert made.where("node_type = 'Author'").count() == 3


def test_knowledge_json_numbers_nodes_once(spark, monkeypatch):
    nodes = spark.createDataFrame([("b", "Section", "two"), ("a", "Section", "one")], "node_id string, node_type string, content string")
    edges = spark.createDataFrame([("a", "b", "Hierarchical", "x", 0)], "src string, dst string, edge_type string, label string, ord long")
    calls = []
    real = export.numbered
    monkeypatch.setattr(export, "numbered", lambda rows, *by: (calls.append(rows.columns), real(rows, *by))[1])
    got = [r["json"] for r in export.knowledge_json(graph.Graph(nodes, edges)).orderBy("part", "at").collect()]
    assert len(calls) == 1
    assert '"id":"a"' in got[1] and '"id":"b"' in got[2] and '"source":0,"target":1' in got[3]


def test_reached_ends_leave_the_steps(spark, monkeypatch):
    pairs = [(f"r{k}", "hub") for k in range(50)] + [("hub", "x"), ("x", "y"), ("y", "z"), ("z", "hub")]
    nodes = spark.createDataFrame([(n, "Text", "t") for n in {x for p in pairs for x in p}], "node_id string, node_type string, content string")
    edges = spark.createDataFrame([(a, b, "Citation", "", 0) for a, b in pairs], "src string, dst string, edge_type string, label string, ord long")
    tables = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (tables.append((name, out := real(df, name))), out)[1])
    got = {r["node_id"]: r["depth"] for r in graph.reachable(graph.Graph(nodes, edges)).collect()}
    assert got == {f"r{k}": 0 for k in range(50)} | {"hub": 1, "x": 2, "y": 3, "z": 4}
    sizes = [t.count() for name, t in tables if name == "steps"]
    assert sizes[0] == 54 and sizes[1] == 3 and sizes[-1] <= 1
