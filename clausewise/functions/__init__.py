"""Column functions: text, geometry and similarity rules of contract documents."""
