"""Word lists that typing, validity and answer rules are defined by, in natural order."""

STOPWORDS = [
    "a", "about", "after", "all", "also", "an", "and", "are", "as", "at", "be", "been", "between", "by", "but", "can", "could", "during", "for",
    "from", "has", "have", "how", "in", "into", "is", "it", "its", "list", "may", "more", "not", "of", "on", "or", "other", "patients", "reported",
    "several", "should", "show", "such", "than", "that", "the", "their", "these", "this", "to", "using", "was", "were", "what", "when", "where",
    "which", "with", "without",
]
DOMAIN_TERMS = [
    "acid", "activation", "allele", "antibody", "antigen", "assay", "blood", "bone", "cancer", "carcinoma", "cell", "clinical", "deficiency",
    "disease", "dna", "dose", "drug", "enzyme", "expression", "factor", "gene", "genetic", "genome", "growth", "human", "immune", "infection",
    "inhibitor", "kinase", "ligand", "mutation", "neuron", "pathway", "protein", "receptor", "response", "rna", "serum", "signaling", "syndrome",
    "therapy", "transcription", "treatment", "tumor", "virus",
]
DOMAIN_SUFFIXES = ["ase", "itis", "emia", "oma", "opathy", "osis", "genic", "globin", "kinase", "protein", "receptor", "syndrome"]
LOW_INFORMATION = [
    "acid", "activation", "assay", "background", "biological", "blood", "case", "cell", "clinical", "conclusion", "conclusions", "data", "decrease",
    "disease", "diagnosis", "dose", "drug", "enzyme", "expression", "factor", "fast", "gene", "genetic", "growth", "human", "immune", "increase",
    "involves", "infection", "method", "methods", "mutation", "new", "objective", "one", "pathway", "patients", "phase", "protein", "procedure",
    "receptor", "results", "response", "na", "serum", "signaling", "syndrome", "therapy", "treatment", "tumor", "ii", "iii",
]
TYPE_HINTS = [
    ("disease", ["cancer", "carcinoma", "deficiency", "disease", "disorder", "infection", "syndrome", "tumor"]),
    ("drug_or_therapy", ["agonist", "antagonist", "antibiotic", "antibody", "drug", "inhibitor", "therapy", "treatment"]),
    ("gene_or_genetic", ["allele", "dna", "gene", "genetic", "genome", "mutation", "rna"]),
    ("protein_or_pathway", ["enzyme", "factor", "kinase", "ligand", "protein", "receptor"]),
]
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "κ": "kappa", "λ": "lambda", "μ": "mu"}
NEGATIVE = [
    "no", "not", "without", "failed to", "failure to", "did not", "does not", "do not", "was not", "were not", "cannot", "could not", "lack of", "lacks", "unlikely", "no significant", "not associated", "negative",
]
HEDGE = ["may", "might", "could", "possible", "possibly", "suggest", "suggests", "uncertain", "unclear", "inconclusive", "insufficient", "limited evidence", "further studies"]
ANSWERS = ["yes", "no", "maybe"]
EVIDENCE_LADDER = [
    ("guideline", 1.0, r"\b(guideline|practice guideline|recommendation)\b"),
    ("meta_analysis", 0.95, r"\b(meta-analysis|meta analysis|systematic review)\b"),
    ("randomized_trial", 0.9, r"\b(randomi[sz]ed|random allocation|placebo-controlled)\b"),
    ("clinical_trial", 0.8, r"\b(clinical trial|phase [i1]{1,3}\b|phase iv\b)\b"),
    ("cohort", 0.65, r"\b(cohort|prospective|retrospective|case-control)\b"),
    ("case_report", 0.35, r"\b(case report|case series|case study)\b"),
    ("review", 0.6, r"\b(review)\b"),
]
QUESTION_PREFIXES = [
    ("yes_no", ["is ", "are ", "was ", "were ", "does ", "do ", "did ", "can ", "has ", "have "]),
    ("list", ["list ", "which ", "what are", "what is the list"]),
    ("factoid", ["what ", "where ", "when ", "who ", "how many", "how much"]),
    ("summary", ["describe ", "explain ", "how "]),
]


# Descriptors and concepts that are too general to annotate with.
GENERIC_DESCRIPTORS = [
    "adolescent", "adult", "aged", "animals", "case-control studies", "cell line", "cells, cultured", "child", "child, preschool", "female", "humans", "infant",
    "male", "mice", "middle aged", "prospective studies", "rats", "retrospective studies", "time factors", "treatment outcome", "young adult",
]
CONCEPT_TYPES = ["disease", "chemical", "gene", "species", "mutation", "cellline"]
STOP_CONCEPT_IDS = ["", "-", "the", "with", "and", "or", "of", "in", "to", "for", "a", "an"]
