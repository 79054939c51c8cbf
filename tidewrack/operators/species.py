"""Species names, common and scientific."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.labels import normalize_label

# Fixed values: (scientific, common), natural order.
SPECIES = (
    ("Delphinus delphis", "Dauphin commun"),
    ("Stenella coeruleoalba", "Dauphin bleu et blanc"),
    ("Tursiops truncatus", "Grand dauphin"),
    ("Delphinidae", "Delphinidé ind."),
    ("Stenella clymene", "Dauphin clymène"),
    ("Stenella frontalis", "Dauphin tacheté de l'Atlantique"),
    ("Stenella attenuata", "Dauphin tacheté tropical"),
    ("Stenella longirostris", "Dauphin à long bec"),
    ("Lagenodelphis hosei", "Dauphin de Fraser"),
    ("Lagenorhynchus albirostris", "Lagénorhynque à bec blanc"),
    ("Lagenorhynchus acutus", "Lagénorhynque à flancs blancs"),
    ("Cephalorhynchus commersonii", "Dauphin de Commerson"),
    ("Sotalia guianensis", "Sotalie"),
    ("Steno bredanensis", "Sténo"),
    ("Phocoena phocoena", "Marsouin commun"),
    ("Globicephala melas", "Globicéphale noir"),
    ("Globicephala macrorhynchus", "Globicéphale tropical"),
    ("Grampus griseus", "Dauphin de Risso"),
    ("Orcinus orca", "Orque"),
    ("Pseudorca crassidens", "Pseudorque (faux orque)"),
    ("Feresa attenuata", "Orque nain"),
    ("Peponocephala electra", "Péponocéphale (Dauphin d'Electre)"),
    ("Ziphius cavirostris", "Ziphius (baleine à bec de Cuvier)"),
    ("Hyperoodon ampullatus", "Hypérodon boréal"),
    ("Hyperoodon planifrons", "Hypérodon austral"),
    ("Mesoplodon bidens", "Mésoplodon de Sowerby"),
    ("Mesoplodon densirostris", "Mésoplodon de Blainville"),
    ("Mesoplodon europaeus", "Mésoplodon de Gervais"),
    ("Mesoplodon layardii", "Mésoplodon de Layard"),
    ("Mesoplodon mirus", "Mésoplodon de True"),
    ("Indopacetus pacificus", "Mésoplodon de Longman (M. du Chili)"),
    ("Berardius bairdii", "Bérardie Boréale"),
    ("Ziphiidae", "Baleine à bec ind."),
    ("Physeter macrocephalus", "Cachalot"),
    ("Kogia breviceps", "Cachalot pygmée"),
    ("Kogia sima", "Cachalot nain"),
    ("Kogia breviceps / K. sima", "Cachalot nain / pygmée"),
    ("Balaenoptera physalus", "Rorqual commun"),
    ("Balaenoptera acutorostrata", "Petit rorqual (R. à museau pointu)"),
    ("Balaenoptera bonaerensis", "Petit rorqual antarctique"),
    ("Balaenoptera musculus", "Rorqual bleu (baleine bleue)"),
    ("Balaenoptera borealis", "Rorqual boréal (R. de Rudolphi)"),
    ("Balaenoptera edeni", "Rorqual de Bryde (tropical)"),
    ("Balaenopteridae", "Rorqual ind."),
    ("Megaptera novaeangliae", "Baleine à bosse (Jubarte)"),
    ("Eubalaena glacialis", "Baleine franche boréale"),
    ("Eubalaena australis", "Baleine franche australe"),
    ("Eubalaena glacialis/australis", "Baleine franche boréale ou australe"),
    ("Eschrichtius robustus", "Baleine grise"),
    ("Delphinapterus leucas", "Belouga"),
    ("Dugong dugon", "Dugong"),
    ("Trichechus manatus", "Lamantin des Caraïbes"),
    ("Cetacea", "Cétacé ind."),
    ("Halichoerus grypus", "Phoque gris"),
    ("Phoca vitulina", "Phoque veau-marin"),
    ("Phoca groenlandica", "Phoque du Groënland"),
    ("Pusa hispida", "Phoque annelé (P. marbré)"),
    ("Cystophora cristata", "Phoque à crête (P. à capuchon)"),
    ("Erignathus barbatus", "Phoque barbu"),
    ("Mirounga leonina", "Eléphant de mer austral"),
    ("Hydrurga leptonyx", "Phoque léopard (Léopard de mer)"),
    ("Leptonychotes weddellii", "Phoque de Weddell"),
    ("Phocidae", "Phoque ind."),
    ("Arctocephalus forsteri", "Otarie à fourrure de Nouvelle-Zélande"),
    ("Arctocephalus gazella", "Otarie à fourrure des Kerguelen"),
    ("Arctocephalus tropicalis", "Otarie à fourrure subantartique"),
    ("Arctocephalus australis", "Otarie à fourrure australe"),
    ("Otariidae", "Otarie ind."),
    ("Odobenus rosmarus", "Morse"),
)


def _names(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        list(SPECIES), "scientific string, common string"
    )


def with_scientific_name(df: DataFrame, label: Column) -> DataFrame:
    """Adds species_common (cleaned) and species_scientific (null for mixed or unknown)."""
    names = _names(df).select(
        F.col("common").alias("_plain"), F.col("scientific").alias("species_scientific")
    )
    cleaned = df.withColumn("species_common", normalize_label(label))
    # Labels listing several species hold a comma and never match.
    plain = F.when(~F.col("species_common").contains(","), F.col("species_common"))
    return (
        cleaned.withColumn("_plain", plain)
        .join(F.broadcast(names), "_plain", "left")
        .drop("_plain")
    )


def with_common_name(df: DataFrame, scientific: Column) -> DataFrame:
    """Adds species_scientific as given (blank is null) and species_common when known."""
    names = _names(df).select(
        F.col("scientific").alias("species_scientific"), F.col("common").alias("species_common")
    )
    return df.withColumn("species_scientific", F.nullif(scientific, F.lit(""))).join(
        F.broadcast(names), "species_scientific", "left"
    )
