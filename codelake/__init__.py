"""codelake: code, document and conversation tables kept and queried with Spark."""
