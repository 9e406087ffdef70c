"""Jobs made of the operators: whole-run reports and the registered queries."""
