"""What rules say to a reader: a description of each finding and what to do about it, in own words."""

from __future__ import annotations

import re

#: Category names of packs that mean a category which other packs name otherwise.
CANONICAL = {"injection": "sql_injection"}

DESCRIPTIONS = {
    "brute_force": "repeated or failed attempts to log in",
    "sql_injection": "parts of a database statement in a request",
    "xss": "script code in a request that a browser could run",
    "path_traversal": "a path that leaves the folder it should stay in",
    "command_injection": "parts of a shell command in a request",
    "webshell": "traces of a program that runs commands sent over the web",
    "log4j": "a lookup that makes the logging library load remote code",
    "persistence": "a change that lets a program start again by itself",
    "lateral_movement": "commands sent from one host to another",
    "credential_theft": "access to stored passwords or tickets",
    "malware": "behaviour of harmful software",
    "privilege_escalation": "a user who gains rights of the administrator",
    "data_exfiltration": "data that leave the system in bulk",
    "dns_tunneling": "name lookups that look like a data channel",
    "denial_of_service": "more requests than the service should get",
    "ransomware": "files that were encrypted for ransom",
    "phishing": "a link that leads users astray",
    "port_scan": "a search for open ports",
    "information_disclosure": "an answer that tells more than it should",
    "file_upload": "an upload of a file that could be run",
    "vulnerability_scan": "requests of a scanning tool",
    "crypto_mining": "connections of a mining program",
    "binary_payload": "a program inside an upload",
}

#: Advice for single rules that is more to the point than that of their category.
ADVICE = {
    "SQLI_UNION": "check which tables the statement could read, and bind parameters",
    "SQLI_UNION_SELECT": "check which tables the statement could read, and bind parameters",
    "SQL Injection - UNION SELECT": "check which tables the statement could read, and bind parameters",
    "SQLI_XPCMD": "switch command procedures of the database off and review its service account",
    "SQL Injection - xp_cmdshell": "switch command procedures of the database off and review its service account",
    "SQLI_DROP_TABLE": "compare the tables with the last backup and take away the right to drop them",
    "SQL Injection - Time Based": "look for slow statements of the same source and bind parameters",
    "LOG4J_RCE": "isolate the host: code was loaded from another server",
    "LOG4J_REMOTE_CLASS": "isolate the host: code was loaded from another server",
    "Log4Shell - Remote Class Loading": "isolate the host: code was loaded from another server",
    "CMD_REVERSE_SHELL": "cut the host's outgoing connections and look for the open shell",
    "RCE - Reverse Shell": "cut the host's outgoing connections and look for the open shell",
    "SENSITIVE_FILE_ACCESS": "check whether the file was sent, and change the secrets in it",
    "Path Traversal - Sensitive Files": "check whether the file was sent, and change the secrets in it",
    "Path Traversal - Config Files": "check whether the settings were sent, and change the secrets in them",
    "CRED_LSASS": "isolate the host and renew the passwords of all who logged in there",
    "CRED_LSASS_ACCESS": "isolate the host and renew the passwords of all who logged in there",
    "CRED_DCSYNC": "find the account that copied the directory and renew the ticket keys",
    "PERSISTENCE_REGISTRY": "remove the start-up entry and keep the program for analysis",
    "PERSISTENCE_TASK": "remove the scheduled task and keep the program for analysis",
    "WEBSHELL_FILENAME": "take the file off the web root and compare the folder with its release",
    "WebShell - Filename": "take the file off the web root and compare the folder with its release",
    "UID_0_USER_CREATE": "lock the new account and find who made it",
    "RANSOMWARE_NOTE": "disconnect the host and check that the backups are out of reach",
    "EVASION_LOG_CLEAR": "restore the log from its copy and look at who cleared it",
}


def canonical(category: str) -> str:
    return CANONICAL.get(category, category)


def describe(rule_id: str, category: str) -> str:
    """What a rule found, with the words of its id: ``parts of a database statement in a request (sqli union)``."""
    words = " ".join(re.findall(r"[A-Za-z0-9]+", rule_id)).lower()
    return f"{DESCRIPTIONS.get(canonical(category), 'a suspicious line')} ({words})"
