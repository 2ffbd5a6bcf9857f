"""Relational operators over triples, entities, candidates and QUBO terms."""
