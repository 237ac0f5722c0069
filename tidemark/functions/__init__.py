"""Column functions: text, URL, address, HTML and rendering."""
