"""Jobs that chain the operators from files to artifacts, reports and gates."""
