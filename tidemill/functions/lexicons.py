"""Keyword lists of the audience score, matched as substrings of lower-case text."""

from __future__ import annotations

LATAM = (
    "latinoamerica", "latinoamérica", "mexico", "méxico", "mexican", "brazil", "brasil", "brazilian", "argentina", "argentine", "chile", "chilean",
    "peru", "perú", "peruvian", "colombia", "colombian", "bogotá", "santiago", "buenos aires", "andes", "amazonas", "amazon", "amazonian", "pantanal",
    "chaco", "oran", "iguazu", "conicet", "unam", "fapesp", "fiocruz", "ufrj", "usp", "unicamp", "galapagos", "patagonian", "atacama",
    "lithium triangle", "chagas", "zika", "dengue", "uruguay", "uruguayan", "paraguay", "paraguayan", "bolivia", "bolivian", "ecuador", "ecuadorian",
    "venezuela", "venezuelan", "costa rica", "costa rican", "panamá", "panama", "panamanian", "guatemalan", "honduran", "nicaraguan", "salvadoran",
    "caribbean", "latin america", "latin american", "españa", "spain", "tec de monterrey", "cdmx",
)

SCIENCE = (
    "study", "research", "scientists", "researchers", "analysis", "data", "evidence", "climate", "drought", "heat wave", "glacier", "health",
    "dengue", "vaccine", "virus", "astronomy", "observatory", "space", "satellite", "ai", "artificial intelligence", "model", "discovery", "detect",
    "reveals", "public health", "education", "policy", "cybersecurity", "privacy", "internet", "platform", "semiconductor", "chip", "battery", "grid",
    "robotics", "biotech", "materials", "energy", "infrastructure", "mobility", "open source",
)

LOW_VALUE = (
    "campus", "student life", "alumni", "alumni engagement", "dean", "provost", "vice provost", "office of", "breakfast", "mentorship portal",
    "award", "leadership", "fundraiser", "fundraising", "donor", "commencement", "menu", "newsletter", "partnership", "partnership announcement",
    "product partnership", "administrative", "internal update", "student government", "portal", "prime day", "black friday", "cyber monday",
    "shopping guide", "gift guide", "coupon", "discount", "price drop", "deal of the day", "travel guide", "flight deal", "hotel deal",
    "packing list", "fashion week", "red carpet", "celebrity style", "beauty routine", "outfit ideas", "dating tips", "election campaign",
    "election results", "candidate debate", "presidential race", "sagemaker", "bedrock", "aws", "amazon web services", "azure", "microsoft cloud",
    "salesforce", "openai blog", "nvidia deep learning", "hugging face blog", "enterprise cloud", "kubernetes", "devops", "terraform",
    "microservices", "tutorial", "how to deploy", "how to build", "sdk", "api gateway", "product launch", "feature release", "developer guide",
    "getting started with", "ios update", "macos", "windows 11", "copilot pro", "supreme court", "abortion pill", "mifepristone", "senate",
    "house of representatives", "gop", "democrat", "republican", "white house", "biden administration", "congressional", "electoral college",
    "governor", "capitol hill", "ood generalization", "out-of-distribution", "mechanistic interpretability", "sparse autoencoders",
    "transformer architecture", "inference scaling", "arxiv:", "mathematical proof", "theorem",
)

TECH = (
    "ai", "artificial intelligence", "cybersecurity", "privacy", "internet", "platform", "software", "semiconductor", "chip", "battery", "grid",
    "robotics", "biotech", "materials", "energy", "infrastructure", "mobility", "open source",
)
