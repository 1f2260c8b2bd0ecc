"""Texts that must equal the data's own spelling for results to be right."""

# Fixed value: coverage text of a study that lists no country.
SENTINEL = "None (global or NA)"

# Fixed value: name given to the group of studies without a matched region.
UNMATCHED_REGION = "multiRegion"

# Basis-of-record vocabulary and the class each term belongs to.
BASIS_CLASSES = {
    "Specimen-based": (
        "FOSSIL_SPECIMEN", "LIVING_SPECIMEN", "MATERIAL_SAMPLE", "PRESERVED_SPECIMEN"),
    "Observation-based": (
        "HUMAN_OBSERVATION", "LITERATURE", "MACHINE_OBSERVATION", "OBSERVATION"),
    "Unknown": ("UNKNOWN",),
}

# Kingdom keys folded into each reporting group; 44 is the vertebrate phylum key.
KINGDOM_GROUPS = {"Fungi": (5,), "Other": (2, 3, 4, 7, 8), "Plants": (6,)}
ANIMAL_KINGDOM = 1
VERTEBRATE_PHYLUM = 44

# Keys of a nested map document, read and written alike.
MAP_KEYS = {"layers": "datasets", "version": "version", "layer": "data", "id": "id",
            "label": "label", "rows": "allData"}

# Common English function words left out of the vocabulary.
STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before
    being below between both but by can could did do does doing down during each few for from
    further had has have having he her here hers herself him himself his how i if in into is it
    its itself just me more most my myself no nor not now of off on once only or other our ours
    ourselves out over own same she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were
    what when where which while who whom why will with would you your yours yourself
    yourselves""".split()
)
