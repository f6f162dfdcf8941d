"""Fixed values of the data model, in the order of their ordinals. Results depend on them; they hold no logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------------

EDGE_TYPES = (
    "Hierarchical Citation CrossReference AuthorAffiliation FigureReference TableReference EquationReference RelatedWork "
    "AuthorMetadata ConceptDependency MethodologyFlow DataDependency ResultSupports TheoremDependency ProofStep Definition "
    "Assumption PriorWork FutureWork AlternativeApproach Limitation DatasetUsage CodeReference SupplementaryLink "
    "ReproducibilityInfo ExperimentalSetup VariableRelation StatisticalLink CausalLink ValidationMethod ComparisonLink "
    "BenchmarkReference MainContribution SubContribution NoveltyLink VersionHistory TimelineLink ArgumentFlow "
    "EvidenceSupport CounterArgument AuthorContribution TeamCollaboration InstitutionalLink ApplicationDomain "
    "ImpactMeasure SocialImpact PeerReviewLink RevisionHistory QualityMetric"
).split()
NODE_TYPES = "Document Section Author Abstract Affiliation Citation Reference Figure Table Equation Environment Text Command Math Unknown".split()
AST_TYPES = "Document Section Command Environment Math Text Label Reference EnvironmentContent Author Affiliation Abstract Citation Bibliography".split()

#: Names under which exports show node types; others are Unknown_ and the ordinal.
NODE_TYPE_NAMES = {
    "Document": "Document",
    "Section": "Sections",
    "Author": "Authors",
    "Affiliation": "Affiliations",
    "Citation": "Citations",
    "Reference": "References",
    "Math": "Math",
    "Command": "Commands",
    "Environment": "Environments",
    "Text": "Text",
}
#: AST types whose display name isn't their own.
AST_TYPE_NAMES_UNKNOWN = ("Label", "Reference", "EnvironmentContent", "Citation")

EDGE_STYLES = {
    "Hierarchical": "style=solid,weight=2",
    "Citation": "style=dashed,color=blue,weight=1",
    "CrossReference": "style=dotted,color=red,weight=1",
    "AuthorAffiliation": "style=bold,color=green,weight=1",
    "FigureReference": "style=dashed,color=purple,weight=1",
    "TableReference": "style=dashed,color=orange,weight=1",
    "EquationReference": "style=dashed,color=brown,weight=1",
    "RelatedWork": "style=dotted,color=gray,weight=1",
}
OTHER_EDGE_STYLE = "style=solid"
SEMANTIC_STYLES = {
    "ConceptDependency": 'color="blue", style="solid", weight=2',
    "Definition": 'color="green", style="dashed"',
    "RelatedWork": 'color="purple", style="dotted"',
    "ResultSupports": 'color="red", style="bold"',
    "TheoremDependency": 'color="orange", style="solid"',
}
OTHER_SEMANTIC_STYLE = 'color="black", style="solid"'

#: Edge types that a pair of node types may carry; any other pair may carry Hierarchical only.
EDGE_RULES = {
    ("Author", "Affiliation"): "AuthorAffiliation",
    ("Author", "Citation"): "Citation",
    ("Section", "Section"): "CrossReference",
    ("Section", "Figure"): "FigureReference",
    ("Section", "Table"): "TableReference",
    ("Section", "Equation"): "EquationReference",
}

#: Child types that an AST node of a type accepts; other parents accept any.
AST_CHILDREN = {
    "Document": "Section Command Text Environment Author Affiliation Abstract Bibliography Math Label Reference EnvironmentContent".split(),
    "Section": "Text Command Math".split(),
    "Math": ["Text"],
    "Environment": "Text Command Math".split(),
    "Author": "Affiliation Text".split(),
}

#: State moves that the document automaton allows; a state that isn't listed allows none.
STATE_MOVES = {
    "Start": "InDocument InCommand",
    "InDocument": "InDocument InSection InCommand InText InMath InAuthor InAbstract InEnvironment",
    "InSection": "InSection InText InCommand InMath InEnvironment",
    "InCommand": "InCommand InDocument InSection InText InAuthor InAffiliation InMath InEnvironment InEquation InAbstract",
    "InText": "InText InCommand InMath InSection InEnvironment",
    "InEnvironment": "InEnvironment InText InCommand InMath InFigure InTable",
    "InEquation": "InEquation InText InMath",
    "InMath": "InMath InText InDocument InEquation InCommand",
    "InFigure": "InFigure InText InCommand InEnvironment",
    "InTable": "InTable InText InCommand InEnvironment",
    "InBibliography": "InBibliography InText InCommand",
    "InAuthor": "InAuthor InAffiliation InText InCommand",
    "InAffiliation": "InAffiliation InAuthor InText InCommand",
    "InAbstract": "InAbstract InText InCommand InMath",
}

#: Command classes in the order in which they are tried; a command in none is generic.
COMMAND_CLASSES = {
    "document": "documentclass usepackage title author date maketitle begin end institute abstract keywords thanks acknowledgements",
    "section": "section subsection subsubsection paragraph subparagraph part chapter",
    "math": (
        "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega "
        "sum int prod coprod bigcup bigcap frac sqrt partial nabla infty lim sup inf "
        "leq geq equiv sim simeq approx propto equation align gather multline matrix cases "
        "mathbf mathcal mathit mathrm mathsf mathtt"
    ),
    "theorem": "theorem lemma proposition corollary definition remark proof example notation claim",
    "float": "figure table algorithm listing includegraphics caption subfigure subfloat",
    "citation": "cite citep citet citeyear citeauthor bibliographystyle bibliography bibitem",
    "reference": "label ref eqref pageref autoref cref",
}
SECTION_LEVELS = {"part": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
DISPLAY_MATH = ("equation", "align", "gather")
REFERENCE_KINDS = {"eqref": "equation", "ref": "standard", "autoref": "auto"}

#: How AST types become graph types when the automaton walks; Citation becomes none.
AST_TO_GRAPH = {t: t for t in "Document Author Affiliation Section Reference Command Text Math Environment".split()} | {
    "Abstract": "Environment",
    "Bibliography": "Section",
    "Label": "Reference",
    "EnvironmentContent": "Text",
}

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
YEAR = r"(^|[^A-Za-z0-9_])((19|20)[0-9]{2})([^A-Za-z0-9_]|$)"
INCLUDE = r"\\(input|include)\{([^}]+)\}"
ENCODINGS = (r"\\usepackage\[(.*?)\]\{inputenc\}", r"\\inputencoding\{(.*?)\}", r"\\begin\{CJK\*\}\{(.*?)\}\{.*\}")
AFFILIATION = r"\\affiliation\s*(?:\[[^\]]*\])?\s*\{([^}]*?)\}"
INLINE_MATH = r"\$(.*?)\$"

METHOD_SECTION = ("method", "approach", "implementation")
COMPLETE_METHOD_SECTION = ("method", "approach")
METHOD_COMPONENT = ("method", "approach", "implementation", "procedure", "algorithm")
DEPARTMENT_WORDS = ("Department", "School")
INSTITUTION_WORDS = ("University", "Institute")

#: Edge types that raise a theme's weight, and weights of node types.
THEME_EDGE_WEIGHTS = {"MainContribution": 2.0, "RelatedWork": 1.5, "ResultSupports": 1.3}
THEME_NODE_WEIGHTS = {"Section": 2.0, "Abstract": 3.0, "Author": 0.5}
#: What a node that has the first kind of edge should also have, and what is said if it hasn't.
LOGICAL_PAIRS = (
    ("Assumption", "ResultSupports", "Missing connection between assumption and results"),
    ("MethodologyFlow", "ValidationMethod", "Missing validation for methodology step"),
    ("MainContribution", "EvidenceSupport", "Missing evidence for main contribution"),
    ("DataDependency", "ResultSupports", "Missing connection between data and results"),
)
METHODOLOGY_NEEDS = ("DataDependency", "MethodologyFlow", "ResultSupports", "ValidationMethod")
EVIDENCE_EDGES = ("EvidenceSupport", "ResultSupports", "ValidationMethod")
CLAIM_EDGES = ("MainContribution", "SubContribution")

# --- lookups ----------------------------------------------------------------------------------------------------------


def lookup(values: dict, key: Column, other: Column | None = None) -> Column:
    """The value for key as a CASE, which folds into the plan; other where the key isn't there."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if other is None else out.otherwise(other)


def ordinal(names: list[str], key: Column) -> Column:
    """Place of the name among names; null if it isn't one."""
    place = F.array_position(F.array(*map(F.lit, names)), key)
    return F.when(place > 0, (place - 1).cast("int"))


def command_class(name: Column) -> Column:
    out = None
    for kind, members in COMMAND_CLASSES.items():
        test = name.isin(members.split())
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("generic")


def state_moves(spark: SparkSession) -> DataFrame:
    """(from_state, to_state): the allowed moves."""
    return spark.createDataFrame([(a, b) for a, to in STATE_MOVES.items() for b in to.split()], "from_state string, to_state string")


def edge_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*k, v) for k, v in EDGE_RULES.items()], "src_type string, dst_type string, allowed string")


def ast_children(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c) for p, cs in AST_CHILDREN.items() for c in cs], "parent_type string, child_type string")
