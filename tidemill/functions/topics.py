"""Keywords of topics, words of praise and warning, and names of entities, for each language and for all."""

from __future__ import annotations

LANGUAGES = ("en", "es", "pt", "fr")

TOPICS = {
    "space": {
        "shared": ("space", "espacio", "espaço", "espace", "lunar", "orbit", "orbital", "rocket", "cohete", "foguete", "fusée"),
        "en": ("nasa", "artemis", "orion"), "es": ("nasa", "lunar"), "pt": ("nasa", "orbital"), "fr": ("esa", "ariane", "européenne"),
    },
    "science": {
        "shared": ("science", "ciencia", "ciência", "scientifique", "recherche", "research", "investigación", "pesquisa", "laboratorio", "laboratory", "laboratoire"),
        "en": ("scientists", "researchers"),
        "es": ("investigadores", "científicos", "cientifico", "científica", "cientificos", "cientificas", "equipo científico"),
        "pt": ("pesquisadores", "cientistas", "cientista"), "fr": ("chercheurs", "scientifiques"),
    },
    "health": {
        "shared": ("health", "salud", "santé", "sanitario"), "en": ("ministry of health", "hospital"), "es": ("ministerio de salud", "hospital"),
        "pt": ("saúde", "hospital"), "fr": ("ministère de la santé", "hôpital"),
    },
    "technology": {
        "shared": ("technology", "tecnología", "tecnologia", "technologie", "ai", "ia", "inteligencia artificial", "inteligência artificial"),
        "en": ("platform", "software"), "es": ("plataforma", "software"), "pt": ("plataforma", "software"), "fr": ("plateforme", "logiciel"),
    },
    "climate": {
        "shared": ("climate", "clima", "climático", "climática", "climatique", "emissions", "emisiones", "emissões", "émissions", "carbon", "carbono", "carbone"),
        "en": ("climate", "carbon"), "es": ("emisiones", "climática"), "pt": ("climática", "amazônia"), "fr": ("climatique", "carbone"),
    },
    "economy": {
        "shared": ("economy", "economía", "economia", "économie", "market", "mercado", "marché", "inflation", "recession", "recesión", "recessão"),
        "en": ("inflation", "recession"), "es": ("inflación", "recesión"), "pt": ("inflação", "recessão"), "fr": ("inflation", "récession"),
    },
}

POSITIVE = {
    "shared": ("confirmed", "progress", "celebrated", "avance", "avances", "innovador", "innovadora", "soluciones", "parceria", "sucesso"),
    "en": ("confirmed", "progress", "celebrated"), "es": ("avance", "celebró", "soluciones", "positivo", "positiva"),
    "pt": ("celebraram", "parceria", "inovador"), "fr": ("succès", "avancée"),
}
NEGATIVE = {
    "shared": ("warned", "risk", "crisis", "preocupante", "urgente", "urgentes", "inflation", "recession", "recesión", "recessão"),
    "en": ("warned", "recession", "risk", "negative"), "es": ("alerta", "preocupante", "urgente", "urgentes"),
    "pt": ("crise", "alerta"), "fr": ("alerte", "inquiétude"),
}

#: (pattern, whether case matters); the name of an entity is its pattern.
ENTITIES = {
    "shared": (("NASA", False), ("Google", False), ("Mars", False), ("ESA", False), ("IMF", False), ("ONU", False)),
    "en": (("Artemis II", False), ("Orion", False), ("Wall Street", False)),
    "es": (("Ministerio de Salud de Chile", False), ("Universidad Nacional Autónoma de México", False), ("Telefónica", False), ("IA", True)),
    "pt": (("Universidade de São Paulo", False), ("Amazônia", False)),
    "fr": (("Agence spatiale européenne", False), ("Ariane 6", False)),
}
