"""Banking tables: silver, gold, features, model, scoring, monitoring, documents."""
