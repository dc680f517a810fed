"""Models and batch plans on top of the operators."""
