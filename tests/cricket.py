"""The small graph of players and teams that the query tests use."""

from loomgraph.operators.graph import PropertyGraph
from loomgraph.schema import GraphSchema

SCHEMA = GraphSchema.from_dict(
    {
        "nodes": {"Player": {"name": {"type": "string", "required": True}, "country": {"type": "string"}}, "Team": {"name": {"type": "string", "required": True}}},
        "edges": {"PLAYS_FOR": {"from": "Player", "to": "Team"}, "DISMISSED_BY": {"from": "Player", "to": "Player", "properties": {"type": {"type": "string"}}}},
    }
)
PLAYERS = [(1, "kohli", "V Kohli", "India"), (2, "bumrah", "J Bumrah", "India"), (3, "starc", "M Starc", "Australia"), (4, "smith", "S Smith", "Australia")]
TEAMS = [(5, "mi", "Mumbai Indians"), (6, "rcb", "Royal Challengers")]
PLAYS_FOR = [(1, 6, 0), (2, 5, 1), (3, 5, 2), (4, 6, 3)]
DISMISSED_BY = [(1, 3, 4, "caught"), (1, 2, 5, "lbw"), (1, 3, 6, "bowled"), (4, 2, 7, "caught")]


def cricket(spark) -> PropertyGraph:
    nodes = {"Player": spark.createDataFrame(PLAYERS, "id long, key string, name string, country string"), "Team": spark.createDataFrame(TEAMS, "id long, key string, name string")}
    edges = {"PLAYS_FOR": spark.createDataFrame(PLAYS_FOR, "src long, dst long, seq long"), "DISMISSED_BY": spark.createDataFrame(DISMISSED_BY, "src long, dst long, seq long, type string")}
    return PropertyGraph(spark, SCHEMA, nodes, edges, frozenset({"PLAYS_FOR"}))
