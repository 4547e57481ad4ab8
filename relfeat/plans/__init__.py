"""Plans: feature definitions, their synthesis from a schema, and their compilation into one DataFrame."""
