"""Dictionary tables made by rules: products from name stems and their classes, events from sites and complaints.

Tables as large as a real vocabulary's core (several hundred surfaces), written as Parquet by write_lexicon() so that
callers can put their own in place of them. Every row is (kind, surface, concept, parent, root).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Stem of a generic name: (class, beginnings). Public non-proprietary names.
STEMS = {
    "statin": ("C10AA", "atorva fluva lova pitava prava rosuva simva"),
    "pril": ("C09AA", "benaze capto enala fosino imida lisino moexi perindo quina rami trandola zofeno"),
    "sartan": ("C09CA", "azil cande epro irbe lo olme telmi val"),
    "olol": ("C07AB", "acebut aten betax bisopr carte metopr nad nebiv pind propran tim"),
    "dipine": ("C08CA", "amlo felo isra lacidi lercani nicar nife niso nitren"),
    "prazole": ("A02BC", "dexlanso esome lanso ome panto rabe"),
    "tidine": ("A02BA", "cime famo niza rani"),
    "gliptin": ("A10BH", "alo lina saxa sita vilda"),
    "gliflozin": ("A10BK", "cana dapa empa ertu sota"),
    "glutide": ("A10BJ", "albi dula lira sema"),
    "glitazone": ("A10BG", "pio rosi"),
    "setron": ("A04AA", "dola grani ondan palono tropi"),
    "triptan": ("N02CC", "almo ele frova nara riza suma zolmi"),
    "azepam": ("N05BA", "br clon di flur lor ox tem"),
    "oxetine": ("N06AB", "atom dul flu par rebo"),
    "ipramine": ("N06AA", "clom des im tr"),
    "cillin": ("J01C", "amoxi ampi cloxa dicloxa flucloxa naf oxa penicillin_g_benza pipera tica"),
    "floxacin": ("J01MA", "cipro gati levo moxi nor o pe"),
    "mycin": ("J01F", "azithro clarithro clinda dapto erythro genta strepto tobra vanco"),
    "cycline": ("J01A", "doxy mino omada tetra tige"),
    "conazole": ("J02AC", "flu isavu itra keto posa vori"),
    "ciclovir": ("J05AB", "a ganc penc vala"),
    "tinib": ("L01E", "afa bosu dasa erlo gefi ima lapa nilo pazopa ruxoli suni"),
    "ximab": ("L04A", "basili cetu infli ritu"),
    "zumab": ("L04B", "bevaci dacli eculi natali omali pertu trastu"),
    "lukast": ("R03DC", "monte pran zafir"),
    "terol": ("R03AC", "albu arformo formo inda olda salme vilan"),
    "dronate": ("M05BA", "alen clo iban pami rise zole"),
    "profen": ("M01AE", "feno flurbi ibu keto dexketo"),
    "thiazide": ("C03A", "bendroflume chloro hydrochloro"),
    "parin": ("B01AB", "dalte enoxa he tinza"),
    "xaban": ("B01AF", "api edo riva"),
}
#: Site: (noun, system).
SITES = {
    "head": "Nervous", "neck": "Musculoskeletal", "chest": "Cardiac", "back": "Musculoskeletal", "stomach": "Gastrointestinal", "abdominal": "Gastrointestinal", "joint": "Musculoskeletal", "muscle": "Musculoskeletal", "eye": "Eye", "ear": "Ear", "throat": "Respiratory", "nose": "Respiratory", "skin": "Skin", "arm": "Musculoskeletal", "leg": "Musculoskeletal", "foot": "Musculoskeletal", "hand": "Musculoskeletal", "hip": "Musculoskeletal", "knee": "Musculoskeletal", "shoulder": "Musculoskeletal", "jaw": "Musculoskeletal", "mouth": "Gastrointestinal", "tongue": "Gastrointestinal", "lip": "Skin", "face": "Skin", "scalp": "Skin", "nail": "Skin", "breast": "Reproductive", "pelvic": "Reproductive", "kidney": "Renal", "bladder": "Renal", "liver": "Hepatobiliary", "tendon": "Musculoskeletal", "bone": "Musculoskeletal", "injection site": "General",
}
#: Complaint in lay words: the term for it.
COMPLAINTS = {
    "pain": "pain", "ache": "pain", "hurts": "pain", "soreness": "pain", "swelling": "swelling", "puffiness": "swelling", "rash": "rash", "itching": "pruritus", "burning": "burning sensation", "numbness": "hypoaesthesia", "tingling": "paraesthesia", "bleeding": "haemorrhage", "infection": "infection", "cramps": "spasm", "stiffness": "stiffness",
}
#: Single events: (surface, term, system).
EVENTS = [
    ("nausea", "nausea", "Gastrointestinal"), ("queasy", "nausea", "Gastrointestinal"), ("threw up", "vomiting", "Gastrointestinal"), ("vomiting", "vomiting", "Gastrointestinal"), ("loose stools", "diarrhoea", "Gastrointestinal"), ("dizzy", "dizziness", "Nervous"), ("dizziness", "dizziness", "Nervous"), ("light headed", "dizziness", "Nervous"), ("fainted", "syncope", "Nervous"), ("passed out", "syncope", "Nervous"), ("seizure", "seizure", "Nervous"), ("shaky hands", "tremor", "Nervous"), ("brain fog", "cognitive disorder", "Nervous"), ("racing heart", "palpitations", "Cardiac"), ("heart attack", "myocardial infarction", "Cardiac"), ("short of breath", "dyspnoea", "Respiratory"), ("hives", "urticaria", "Skin"), ("hair loss", "alopecia", "Skin"), ("could not sleep", "insomnia", "Psychiatric"), ("insomnia", "insomnia", "Psychiatric"), ("felt low", "depressed mood", "Psychiatric"), ("depression", "depression", "Psychiatric"), ("anxiety", "anxiety", "Psychiatric"), ("tired", "fatigue", "General"), ("fatigue", "fatigue", "General"), ("fever", "pyrexia", "General"), ("weight gain", "weight increased", "Investigations"), ("high blood pressure", "hypertension", "Vascular"), ("nosebleed", "epistaxis", "Respiratory"), ("yellow skin", "jaundice", "Hepatobiliary"),
]
#: Triggers, terminators and phrases that only look like a negation.
CUES = {
    "trigger": ["no", "not", "never", "without", "denies", "denied", "none", "neither", "nor", "absence of", "free of", "pas", "sans", "nicht", "kein", "keine", "ohne", "sin"],
    "terminator": ["but", "however", "although", "except", "mais", "aber", "pero"],
    "pseudo": ["not only", "not just", "no change", "no longer than"],
}


def lexicon_rows() -> list[tuple[str, str, str, str, str]]:
    """(kind, surface, concept, parent, root): products with their class and its first letter, events with their term
    and system, as nouns and as spoken ("pain in the chest")."""
    rows = []
    for stem, (group, names) in STEMS.items():
        for begin in names.split():
            name = begin.replace("_", " ") + stem
            rows += [("product", s, name, group, group[0]) for s in (name, f"{name} tablets", f"{name} injection")]
    for site, system in SITES.items():
        for said, term in COMPLAINTS.items():
            rows += [("event", s, f"{site} {term}", term, system) for s in (f"{site} {said}", f"{said} in the {site}")]
    rows += [("event", s, term, term, system) for s, term, system in EVENTS]
    return rows + [("cue", s, cue, cue, cue) for cue, surfaces in CUES.items() for s in surfaces]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lexicon_rows(), "kind string, surface string, concept string, parent string, root string")


def write_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The tables as Parquet, a folder a kind, read again."""
    lexicon(spark).write.mode("overwrite").partitionBy("kind").parquet(path)
    return spark.read.parquet(path)
