"""Query language and the search facade."""
