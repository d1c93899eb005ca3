"""Semantic-graph analytics on Spark.

``operators``  query algebra, mutations, identification, repair jobs, closures
``sources``    graph files in and out, file metadata, extractors
``functions``  column expressions: typed lanes, full text, formatting
``plans``      the relational lift, the ontology and the term planner
``streaming``  live queries, change feeds and file-event state machines
"""
