"""Query language front end: text to syntax tree to DataFrame plan."""
