"""Extensions: relational operators that content addressing itself does not need."""
