"""See the package docstring for the layout."""
