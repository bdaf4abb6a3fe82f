from rosterlab.operators.identity import IdentityTables
from rosterlab.sources import identity_store as store


def identity_tables(spark):
    players = [(5, "A One", "A", "One", "QB", "KC", None, 1), (6, "B Two", "B", "Two", "RB", "DEN", None, 2)]
    ids = [(5, "site", "9", "A One", 1.0), (6, "site", "10", "B Two", 1.0)]
    aliases = [(5, "Ace", None, 1.0), (6, "Ace", None, 1.0), (5, "A.One", "nfl_api", 0.9)]
    return IdentityTables(
        spark.createDataFrame(players, store.PLAYERS), spark.createDataFrame(ids, store.EXTERNAL_IDS), spark.createDataFrame(aliases, store.ALIASES)
    )
