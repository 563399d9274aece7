"""Rules on names and values that the parse and Column expressions share; patterns that Python and Java read alike."""

# What a name tells of a credential, and what stands in for one.
CREDENTIAL_NEEDLES = ["password", "passwd", "pwd", "secret", "api_key", "apikey", "access_key", "accesskey", "auth_token", "authtoken", "private_key", "privatekey"]
CREDENTIAL = "|".join(CREDENTIAL_NEEDLES)
PLACEHOLDER = r"(?is)^(?:|changeme|todo|x{3,}|your.*|<.*>|\{\{.*\}\}|\$\{.*\})$"
