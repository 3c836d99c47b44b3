"""Namespaces, predicates, tiers, roles and templates: fixed values of the text strategies."""

from __future__ import annotations

from dataclasses import dataclass, field

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
OBO = "http://purl.obolibrary.org/obo/"
FMA = "http://purl.org/sig/ont/fma/"
OBO_IN_OWL = "http://www.geneontology.org/formats/oboInOwl#"
DC = "http://purl.org/dc/elements/1.1/"
DCTERMS = "http://purl.org/dc/terms/"
SCHEMA_ORG = "http://schema.org/"
FOAF = "http://xmlns.com/foaf/0.1/"
DBKWIK = "http://dbkwik.webdatacommons.org/ontology/"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS, "obo": OBO, "fma": FMA, "oboInOwl": OBO_IN_OWL}


def expand(name: str) -> str:
    """Full URI of a prefixed name; a full URI stays, an unknown prefix raises ValueError."""
    if name.startswith(("http://", "https://")):
        return name
    prefix, _, local = name.partition(":")
    if not local or prefix not in PREFIXES:
        raise ValueError(f"unknown prefixed name {name!r}")
    return f"{PREFIXES[prefix]}{local}"


def _all(names: str) -> list[str]:
    return [expand(x) for x in names.split()]


TYPE, LABEL, SUBCLASS = expand("rdf:type"), expand("rdfs:label"), expand("rdfs:subClassOf")
PREF_LABEL, ALT_LABEL, SAME_AS = expand("skos:prefLabel"), expand("skos:altLabel"), expand("owl:sameAs")

# Which classes make a subject a class or a predicate.
CLASS_TYPES = _all("owl:Class rdfs:Class skos:Concept")
PREDICATE_TYPES = _all("owl:ObjectProperty owl:DatatypeProperty rdf:Property")
RESOLVED_CLASS_TYPES = _all("owl:Class rdfs:Class")

# Predicates that label choices and annotations read, in order.
LABELS_ABC = _all("rdfs:label skos:prefLabel skos:altLabel")
LABELS_D = _all("rdfs:label skos:prefLabel")
DEFINITIONS = _all("rdfs:comment skos:definition obo:IAO_0000115 fma:definition oboInOwl:hasDefinition")
SYNONYMS = _all(
    "skos:altLabel fma:synonym fma:slot_synonym oboInOwl:hasExactSynonym oboInOwl:hasRelatedSynonym oboInOwl:hasNarrowSynonym "
    "oboInOwl:hasBroadSynonym oboInOwl:hasSynonym"
)

# Predicate tiers by entity type, highest priority first.
TIERS: dict[str, list[list[str]]] = {
    "class": [
        _all("rdfs:label skos:prefLabel skos:altLabel obo:hasExactSynonym obo:hasSynonym obo:IAO_0000115 rdfs:comment skos:definition"),
        _all("rdf:type rdfs:subClassOf rdfs:domain rdfs:range"),
        _all("owl:equivalentClass skos:exactMatch"),
        [], [], [],
    ],
    "instance": [_all("rdf:type rdfs:label skos:prefLabel"), [], [], _all("owl:sameAs skos:exactMatch")],
    "predicate": [
        _all("rdfs:label skos:prefLabel rdfs:comment"),
        _all("rdfs:domain rdfs:range"),
        _all("rdfs:subPropertyOf owl:inverseOf owl:equivalentProperty"),
    ],
}

# The role of each predicate in the role map roles_v1.
ROLES_V1: dict[str, str] = {
    uri: role
    for role, names in {
        "core": "rdfs:label rdf:type rdfs:subClassOf",
        "preferred_name": "skos:prefLabel fma:preferred_name",
        "synonym": "skos:altLabel fma:synonym fma:slot_synonym oboInOwl:hasExactSynonym oboInOwl:hasRelatedSynonym "
        "oboInOwl:hasNarrowSynonym oboInOwl:hasBroadSynonym oboInOwl:hasSynonym",
        "definition": "skos:definition fma:definition oboInOwl:hasDefinition obo:IAO_0000115 rdfs:comment",
        "identifier": "fma:FMAID fma:RadLex_ID fma:Talairach fma:AAL fma:DK__Freesurfer_ fma:Neurolex fma:fma0329122 fma:CMA_label "
        "oboInOwl:hasAlternativeId oboInOwl:hasDbXref",
        "non_english": "fma:non-English_equivalent",
        "disjointness": "owl:disjointWith",
        "other": "fma:JHU_DTI-81 fma:JHU_White-Matter_Tractography_Atlas fma:homonym_for fma:homonym_of fma:Eponym",
    }.items()
    for uri in _all(names)
}
ROLES = ("core", "preferred_name", "synonym", "definition", "identifier", "non_english", "disjointness", "other")

# The groups of the order "role"; a predicate's own group comes before its role's.
ROLE_ORDER = (LABEL, "preferred_name", "synonym", "definition", SUBCLASS, TYPE, "disjointness", "non_english", "identifier", "other")
RENDER_ORDERS = ("uri", "core", "label", "role")


@dataclass(frozen=True)
class Vocabulary:
    """Which predicates a covered filter keeps, and their tiers."""

    name: str
    covered: frozenset[str]
    tiers: dict[str, list[list[str]]]
    roles: dict[str, str] = field(default_factory=dict)


def _base(tiers: dict[str, list[list[str]]], name: str, lexical: list[str] = [], identifiers: list[str] = []) -> Vocabulary:  # noqa: B006
    tiers = {k: [list(t) for t in v] for k, v in tiers.items()}
    tiers["class"][0] += lexical
    covered = {p for v in tiers.values() for t in v for p in t} | set(identifiers)
    return Vocabulary(name, frozenset(covered), tiers, {**dict.fromkeys(lexical, "lexical"), **dict.fromkeys(identifiers, "identifier")})


def _swapped() -> dict[str, list[list[str]]]:
    swap = {expand(f"obo:{n}"): expand(f"oboInOwl:{n}") for n in ("hasExactSynonym", "hasSynonym")}
    return {k: [[swap.get(p, p) for p in t] for t in v] for k, v in TIERS.items()}


VOCABULARIES: dict[str, Vocabulary] = {
    v.name: v
    for v in (
        _base(TIERS, "base"),
        _base(TIERS, "fma_extended", _all("fma:preferred_name fma:synonym"), _all("fma:FMAID")),
        _base(
            TIERS, "obo_extended",
            _all("oboInOwl:hasExactSynonym oboInOwl:hasRelatedSynonym oboInOwl:hasNarrowSynonym oboInOwl:hasBroadSynonym oboInOwl:hasSynonym oboInOwl:hasDefinition"),
            _all("oboInOwl:hasAlternativeId oboInOwl:hasDbXref"),
        ),
        _base(_swapped(), "base_v2"),
    )
}

# Sentence templates of strategy V3.
SENTENCES: dict[str, str] = {
    expand("rdfs:subClassOf"): "{entity} is a subclass of {object}.",
    expand("rdf:type"): "{entity} is a {object}.",
    expand("owl:equivalentClass"): "{entity} is equivalent to {object}.",
    expand("owl:disjointWith"): "{entity} is disjoint from {object}.",
    expand("rdfs:domain"): "The domain of {entity} is {object}.",
    expand("rdfs:range"): "The range of {entity} is {object}.",
    expand("rdfs:label"): "{entity} is called {object}.",
    expand("rdfs:comment"): "{entity}: {object}.",
    expand("owl:inverseOf"): "{entity} is the inverse of {object}.",
    expand("rdfs:subPropertyOf"): "{entity} is a sub-property of {object}.",
}
DATATYPE_SENTENCE = "{entity} has {predicate} {object}."
OTHER_SENTENCE = "{entity} {predicate} {object}."

# Predicate families that a relational signature leaves out; the first that has a predicate names it.
EXCLUDED: dict[str, list[str]] = {
    "type_and_label": [TYPE, LABEL],
    "roles_v1_annotation": sorted(p for p, role in ROLES_V1.items() if role not in ("core", "disjointness")),
    "owl_annotation": [RDFS + x for x in "comment seeAlso isDefinedBy".split()]
    + [OWL + x for x in "versionInfo deprecated priorVersion backwardCompatibleWith incompatibleWith".split()],
    "owl_axiom_annotation": [OWL + x for x in "annotatedSource annotatedProperty annotatedTarget".split()],
    "skos_documentation": [
        SKOS + x for x in "prefLabel altLabel hiddenLabel definition note scopeNote editorialNote changeNote historyNote example".split()
    ],
    "dublin_core": [n + x for n in (DC, DCTERMS) for x in "title description rights".split()],
    "schema_org": [SCHEMA_ORG + x for x in "name alternateName description".split()],
    "foaf": [FOAF + x for x in "name givenName familyName nick depiction thumbnail".split()],
    "dbkwik_page": [DBKWIK + x for x in "abstract thumbnail wikiPageWikiLinkText wikiPageExternalLink".split()],
}

# First hop and climb of the ancestor chain, by entity type.
PARENTS = {"class": (SUBCLASS, SUBCLASS), "instance": (TYPE, SUBCLASS), "predicate": (expand("rdfs:subPropertyOf"),) * 2}
